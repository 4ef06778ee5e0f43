from collections import Counter, defaultdict
import zlib

import numpy as np
import pytest

from plugload.llm import packing as P, queries as Q, toxicity as T

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, score string, length string, sequence_id string"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in Q.op1_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    test = [i for i in labels if held_out(i)]
    toxic = [rows[i]["score"] for i in test if labels[i]]
    clean = [rows[i]["score"] for i in test if not labels[i]]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9
    assert np.mean([rows[i]["predicted"] for i in test if not labels[i]]) < 0.05


def test_toxicity_learns_and_scores_odd_texts(spark):
    rng = np.random.default_rng(0)
    words = ["bal", "rin", "tos", "mek", "lun", "dar", "sep"]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" badword" if i % 4 == 0 else ""), "s", "l", "q") for i in range(200)]
    odd = [(1000, None, "", "", ""), (1001, "", "", "", ""), (None, "badword", "", "", ""), (1002, "rin " * 100_000 + "BADWORD", "", "", ""),
           (1002, "rin " * 100_000 + "BADWORD", "", "", ""), (1003, "b", "", "", ""), (1004, "\x07 badword \x07", "", "", "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(5000, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = T.train(docs, labels)
    got = T.score(docs, model)
    assert got.columns == ["doc_id", "text", "length", "sequence_id", "score"]
    by_id = defaultdict(list)
    for r in got.collect():
        by_id[r["doc_id"]].append(r["score"])
    assert all((by_id[i][0] > 0.5) == (i % 4 == 0) for i in range(200))
    assert by_id[None][0] > 0.5 and by_id[1000] == by_id[1001] and by_id[1001][0] < 0.5
    assert len(set(by_id[1002])) == 1 and by_id[1002][0] > 0.5 and by_id[1004][0] > 0.5
    assert T.score(docs.limit(0), model).count() == 0
    one_class = T.train(docs, labels.where("toxic = 0"))
    assert len(one_class.buckets) == 0 and T.score(docs, one_class).where("score < 0.5").count() == docs.count()
    none = T.train(docs, labels.limit(0))
    assert T.score_texts(["a"], none).tolist() == [0.5]


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id bigint, toxic int")
    n = T.training_rows(docs, labels, "doc_id", "text", "toxic", 500).count()
    assert 350 < n <= 500


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_file())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_pieces(df, rows, max_tokens=2048):
    docs = df.collect()
    left = Counter()
    for d, ids in zip(docs, ids_of([d["text"] for d in docs])):
        for s in range(0, len(ids), max_tokens):
            part = np.array(ids[s : s + max_tokens], "<u4").tobytes()
            left[(d["doc_id"], s, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == left
    return check_sequences(rows, max_tokens)


def check_sequences(rows, max_tokens):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= max_tokens
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding / max(sum(r["length"] for r in rows), 1), sequences


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    padding, _ = check_pieces(docs, Q.op7_packing(spark, SF).collect())
    assert padding < 0.02


def test_packing_of_odd_texts(spark):
    texts = [None, "", " \n", "Hello, WORLD's 123", "a\xa0b\x1cc d", "<|endoftext|> x<|startoftext|>y", "é" * 50 + " é", "w " * 5000, "日本語 テキスト", "w " * 5000]
    rows = [(i if i != 3 else None, t, "a", "b", "c") for i, t in enumerate(texts)] + [(0, None, "a", "b", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    check_pieces(df, P.pack_documents(df, Q.tokenizer_file()).collect())
    assert P.pack_documents(df.limit(0), Q.tokenizer_file()).count() == 0


def test_all_limits_hold(spark):
    rng = np.random.default_rng(2)
    items = [(int(i), int(rng.integers(1, 300)), int(rng.integers(0, 100))) for i in range(3000)]
    df = spark.createDataFrame(items, "item bigint, tokens bigint, loss bigint")
    got = P.pack(df, tokens="tokens", loss="loss", max_tokens=1024, max_segments=5, max_loss=256, shard_items=800).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    assert sorted(r["item"] for r in got) == list(range(3000))
    for parts in sequences.values():
        assert len(parts) <= 5 and sum(r["tokens"] for r in parts) <= 1024 and sum(r["loss"] for r in parts) <= 256
    least = max(sum(t for _, t, _ in items) / 1024, len(items) / 5, sum(x for *_, x in items) / 256)
    assert len(sequences) < 1.12 * least


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_items(n):
    bins, ranks = P.pack_shard(np.full((n, 2), 1.0), np.array([4.0, 2.0]))
    assert Counter(bins.tolist()) == Counter({b: min(2, n - 2 * b) for b in range(-(-n // 2))})
