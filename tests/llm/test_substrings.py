from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from plugload.llm import substrings as S

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, places string, row string"


def naive(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def check(df, **more):
    rows = df.collect()
    length = more.get("length", S.LENGTH)
    want = naive([(r["text"] or "").encode() for r in rows], length)
    got = S.remove_repeats(df, carry=["doc_id"], **more).collect()
    fields = ["bytes", "removed", "spans", "sha256"]
    assert Counter((r["row"]["doc_id"], *(r[f] for f in fields)) for r in got) == Counter((r["doc_id"], *w) for r, w in zip(rows, want))
    return want


@pytest.mark.parametrize("length", [1, 5, 7, 8, 20, 200])
def test_suffix_order_equals_sorting(length):
    rng = np.random.default_rng(length)
    for data in (b"a" * 300, bytes(rng.integers(0, 256, 400, np.uint8)), bytes(rng.integers(0, 2, 500, np.uint8)), b"ab" * 130 + b"a", b"\x00", b"\xff\x00" * 90):
        order, rank = S.suffix_order(np.frombuffer(data, np.uint8), length)
        cut = [data[i : i + length] for i in range(len(data))]
        assert [cut[i] for i in order] == sorted(cut)
        number = {c: k for k, c in enumerate(sorted(set(cut)), 1)}
        assert rank.tolist() == [number[c] for c in cut]


def test_repeated_starts_count_the_parse():
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(0, 256, 30, np.uint8))
    phrases = [b"xx" + shared, shared + b"yy", b"q" * 25, b"once more, but only once"]
    once = S.repeated_starts(phrases, [1, 1, 1, 1], 20)
    assert [h.tolist() for h in once] == [[False] * 2 + [True] * 11, [True] * 11 + [False] * 2, [True] * 6, [False] * 5]
    assert S.repeated_starts(phrases, [1, 1, 1, 2], 20)[3].all()


def test_triggers_sorted_apart_or_together(spark, monkeypatch):
    check(made(spark, np.random.default_rng(8)))
    monkeypatch.setattr(S, "SORT_BYTES", 1)
    check(made(spark, np.random.default_rng(8)))


@pytest.mark.parametrize("parts", [1, 50, 10**12])
def test_large_and_small_groups(spark, monkeypatch, parts):
    monkeypatch.setattr(S, "LARGE_GROUPS", parts)
    check(made(spark, np.random.default_rng(9)))


def text(rng, n, letters="abcd "):
    return "".join(rng.choice(list(letters), n))


def made(spark, rng):
    passage, edge = text(rng, 260), text(rng, 200)
    rows = [(i, text(rng, 300) + passage + text(rng, 150)) for i in range(8)]
    rows += [(20, edge), (21, text(rng, 40) + edge), (22, edge + "x"), (23, text(rng, 199)), (24, text(rng, 199))]
    rows += [(30, "a" * 1500), (31, "ab" * 400), (32, text(rng, 350) * 2), (33, "é" * 150), (34, "é" * 99 + "ü" * 150)]
    rows += [(40, None), (41, ""), (42, "short"), (None, text(rng, 500)), (43, passage[:230]), (44, passage[30:])]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (60, rows[1][1]), (60, rows[1][1]), (61, text(rng, 20_000)), (62, passage[5:206] * 3)]
    return spark.createDataFrame([(i, t, "p", "r") for i, t in rows], SCHEMA).repartition(4)


def test_repeats_equal_brute_force(spark):
    want = check(made(spark, np.random.default_rng(5)))
    assert sum(w[1] for w in want) > 5000
    assert S.remove_repeats(made(spark, np.random.default_rng(5)).limit(0)).count() == 0


def test_triggers_with_many_phrases_and_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    check(made(spark, np.random.default_rng(6)), group_phrases=2)
    check(made(spark, np.random.default_rng(7)), length=50, gram=12)


def test_documents_equal_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "a"])
def test_phrases_cover_every_start_once(letters):
    rng = np.random.default_rng(1)
    sizes = np.array([10, 199, 200, 0, 1000, 201, 5000, 450])
    data = np.frombuffer("".join(text(rng, n, letters) for n in sizes).encode(), np.uint8)
    left, right, _ = S.Parser().phrases(data, sizes)
    covered = np.zeros(len(data), int)
    for a, b in zip(left, right):
        covered[a : b + 1] += 1
    want = np.zeros(len(data), int)
    for start, n in zip(np.cumsum(sizes) - sizes, sizes):
        want[start : start + max(0, n - 199)] = 1
    assert (covered == want).all()


def test_kept_text_drops_broken_characters(spark):
    rows = [(1, "é" * 300 + "ü"), (2, "x" + "é" * 300)]
    df = spark.createDataFrame([(i, t, "p", "r") for i, t in rows], SCHEMA)
    got = {r["row"]["doc_id"]: r for r in S.remove_repeats(df, with_text=True).collect()}
    # The first byte of ü is also the first of é and goes with them; its second byte alone is no character.
    assert got[1]["bytes"] - got[1]["removed"] == 1 and got[1]["kept"] == ""
    assert got[2]["kept"] == "x" and got[1]["row"]["places"] == "p"
