from collections import Counter, defaultdict
import re

import pytest
import xxhash
from pyspark.sql import Row

from plugload.llm import mixing, quality, simhash
from plugload.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, size string, bucket string, fp string"

WORDS = [f"w{i}" for i in range(40)]
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\f\r ", None), (4, "one", None), (5, "one two three four", "b"),
    (6, " ".join(WORDS), "b"), (6, " ".join(WORDS), "b"), (7, "x y z u v " * 30, "b"), (8, "a b c d e\na b c d e\n\n \na b c d e", "c"),
    (9, "# $$ | <b> é ü " * 3, "c"), (10, " ".join(f"v{i}" for i in range(30_000)), "c"), (11, " ".join(WORDS[:-1] + ["zz"]), "d"),
    (None, "null id here", "d"), (12, "A b\xa0c D e f g h i j k", "e"),
]


def odd(spark):
    return spark.createDataFrame([(i, t, s, 0, "x", "y", "z") for i, t, s in ODD], SCHEMA).repartition(3)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def naive_quality(text):
    words, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def check_quality(df):
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *(r[f] for f in fields)) for r in quality.host_verdicts(df).collect())
    assert got == Counter((r["doc_id"], *naive_quality(r["text"])) for r in df.collect())


def test_document_rules_equal_brute_force(spark):
    check_quality(odd(spark))
    check_quality(spark.read.parquet(f"{SF}/documents.parquet"))
    assert quality.host_verdicts(odd(spark).limit(0)).count() == 0


def test_host_verdict_needs_evidence(spark):
    good, bad = " ".join(WORDS), "short text"
    rows = [(i, good, f"h{i % 20}", 0, "", "", "") for i in range(2000)]
    rows += [(5000 + i, bad if i % 10 else good, "spam", 0, "", "", "") for i in range(500)]
    rows += [(9000, bad, "tiny", 0, "", "", ""), (9001, good, "tiny", 0, "", "", ""), (9002, good, None, 0, "", "", "")]
    got = {r["doc_id"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[5000]["kept"] and not got[5000]["base_failed"] and got[5000]["host_rejected"]
    assert got[9001]["kept"] and got[9002]["kept"] and not got[9000]["kept"]
    assert all(got[i]["kept"] for i in range(2000))


def naive_print(text):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(prints, radius=3):
    left, out = set(prints), {}
    for start in sorted(prints):
        if start in left:
            left.discard(start)
            front = [start]
            while front:
                at = front.pop()
                out[at] = start
                near = {x for x in left if (prints[x] ^ prints[at]).bit_count() <= radius}
                left -= near
                front += near
    return out


def check_simhash(df, **more):
    rows = simhash.near_duplicates(df, **more).collect()
    texts = df.collect()
    assert len(rows) == len(texts)
    prints = {r["doc_id"]: naive_print(r["text"]) for r in texts if r["doc_id"] is not None}
    groups = naive_groups(prints)
    assert all(r["fp"] % (1 << 64) == prints[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == groups


def test_simhash_equals_brute_force(spark):
    check_simhash(odd(spark))
    check_simhash(spark.read.parquet(f"{SF}/documents.parquet"))
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("flush", [32_768, 7])
def test_near_fingerprints_with_divided_buckets(spark, monkeypatch, flush):
    import random

    monkeypatch.setattr(simhash, "_FLUSH_ROWS", flush)

    rnd = random.Random(1)
    prints = {}
    for c in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(80):
            x = centre
            for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 5, 9])):
                x ^= 1 << b
            prints.setdefault(x, len(prints))
    for x in [rnd.getrandbits(24) << 40 for _ in range(300)]:
        prints.setdefault(x, len(prints))
    signed = [(x - (1 << 64) if x >> 63 else x, i) for x, i in prints.items()]
    want = naive_groups({i: x for x, i in prints.items()})
    for limit in (20_000, 20):
        got = simhash.near_components(spark.createDataFrame(signed, "fp bigint, rep bigint"), 3, limit).collect()
        assert {prints[r["fp"] % (1 << 64)]: r["component"] for r in got} == want


def test_every_threshold_plan_finds_all_links(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    base = rnd.integers(-(2**63), 2**63 - 1, 150)
    near = base ^ (np.int64(1) << rnd.integers(0, 63, 150)) ^ (np.int64(1) << rnd.integers(0, 63, 150))
    values = np.unique(np.concatenate([base, near]))
    fps = spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], "fp bigint, rep bigint")
    want = naive_groups({i: int(v) % (1 << 64) for i, v in enumerate(values)})
    for m, t in ((2, (1, 1)), (2, (0, 2)), (3, (0, 0, 1)), (4, (0, 0, 0, 0)), (3, (1, -1, 2))):
        parts = [simhash.mask_of(list(range(k, 64, m))) for k in range(m)]
        monkeypatch.setattr(simhash, "plan", lambda *_: [(p, x) for p, x in zip(parts, t) if x >= 0])
        got = simhash.near_components(fps).collect()
        values_of = {int(v): i for i, v in enumerate(values)}
        assert {values_of[r["fp"]]: r["component"] for r in got} == want


def test_similar_documents(spark):
    import random

    rnd = random.Random(7)
    vocabulary = [f"word{i}" for i in range(500)]
    rows, want = [], {}
    for g in range(60):
        base = rnd.choices(vocabulary, k=rnd.choice([60, 150, 400]))
        for k in range(rnd.choice([1, 2, 4])):
            text = list(base)
            for _ in range(max(1, len(base) // 150) if k else 0):  # a change touches five of the shingles
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            want[len(rows)] = next((i for i, x in enumerate(rows) if x[2] == str(g)), len(rows))
            rows.append((len(rows), " ".join(text), str(g)))
    n = len(rows)
    rows += [(n, None, ""), (n + 1, " ", ""), (n + 2, "a b", ""), (n + 3, "A  b", ""), (n + 4, "a c", ""), (None, "a b", "")]
    df = spark.createDataFrame([(i, t, s, 0, "", "", "") for i, t, s in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert len(got) == len(rows)
    assert sum(got[i] == want[i] for i in range(n)) >= 0.97 * n and all(rows[got[i]][2] == rows[i][2] for i in range(n))
    assert [got[n + k] - n for k in range(5)] == [0, 0, 2, 2, 4] and got[None] is None
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_thresholds_add_up():
    import numpy as np

    cost = np.array([[0, 5, 9, 20, 40], [0, 1, 2, 3, 4], [0, 7, 7, 7, 7]], float)
    total, t = simhash.allocate(cost, 3)
    assert sum(x + 1 for x in t) == 4 and total == min(4, 1 + 7, 5 + 3)


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 7), (200, 100), (None, 3), (50, i) if False else (50, 51)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 7: 7, 100: 7, 200: 7, 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def naive_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in rest)
        target = {s: (total - sum(fixed.values())) * weight[s] / w for s in rest}
        over = [s for s in rest if target[s] >= 2 * sizes[s]]
        if not over:
            return {**fixed, **target}
        fixed |= {s: 2.0 * sizes[s] for s in over}
        if len(fixed) == len(names):
            return fixed


def check_mix(df):
    docs = df.collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(split(r["text"]))
    targets = naive_targets(sizes)
    mixed = mixing.mix(df)
    rows = mixed.select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "taken").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs)
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == len(split(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(5)).select("row.doc_id", "taken").collect()
    assert Counter(again) == Counter(Row(doc_id=r["doc_id"], taken=r["taken"]) for r in rows)
    copies = mixing.repeated(mixed)
    assert copies.columns == df.columns
    words = defaultdict(int)
    for r in copies.collect():
        words[r["source"]] += len(split(r["text"]))
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_mix_equals_brute_force(spark):
    check_mix(odd(spark))
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"))
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    assert mixing.mix(odd(spark).where("doc_id = 1")).select("taken").collect() == [Row(taken=0)]


def test_mixing_reruns_agree_for_rows_alike(spark):
    """Null and repeated ids of one size: the same rows are taken at any partitioning."""
    rows = [(None, f"{w} b c d", "s", w) for w in "abcdefgh"] + [(7, "x y z", "s", w) for w in "abcdefgh"] + [(i, "k l", "t", "") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tag string")
    found = [
        sorted((repr(r["row"]), r["taken"]) for r in mixing.mix(docs.repartition(n), weights=(3, 2)).collect()) for n in (1, 7, 40)
    ]
    assert found[0] == found[1] == found[2]
