from collections import Counter
import re

import numpy as np
import pytest

from plugload.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, rank string, n string"


def naive(rows, longest=3, min_count=10, top=2000, percent=50):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    covered = {
        (lang, w[i : i + m]) for (lang, w), a in candidates.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)
        if 100 * a >= percent * f[lang, w[i : i + m]]
    }
    found = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in covered:
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
        for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])
    )


def corpus(seed=0, docs=120):
    rng = np.random.default_rng(seed)
    words = ["The", "new", "york", "Times", "über", "c d", "e\x1ff", "zz", "日本", "a", "b", "#", "$x"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", " \r\n ", "!?", "\x0b", " ; ", " ", " ", " ", " "]
    some = []
    for _ in range(docs):
        n = int(rng.integers(0, 60))
        p = np.array([8, 5, 4, 3, 2, 1, 1, 1, 1, 9, 9, 1, 1]) / 46
        some.append("".join(w + g for w, g in zip(rng.choice(words, n, p=p), rng.choice(gaps, n))))
    langs = [None, "en", "de", "", "und"]
    rows = [(t, langs[int(rng.integers(5))]) for t in some]
    rows += [(some[3], "en")] * 30  # copies
    rows += [(None, "en"), ("", "en"), (" .,\t\n", "de"), ("a " * 5000, "de"), ("x" * 100_000, "de"), ("new york " * 3000, None)]
    return rows


@pytest.mark.parametrize("longest, spacing, bits, top", [(3, 12, 20, 2000), (3, 2, 6, 7), (2, 1, 10, 2000), (4, 5, 12, 2000), (5, 3, 4, 50)])
def test_equals_plain_counting(spark, longest, spacing, bits, top):
    """Whatever the triggers and the size of the bitmap, phrases and counts are those of plain counting."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "r", "n") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    got = C.collocations(docs, longest=longest, top=top, spacing=spacing, bits=bits)
    assert sorted(map(tuple, got.collect())) == naive(rows, longest, top=top)


def test_copies_share_entries_and_overlaps_count_once(spark):
    rows = [("one two three four five six seven eight nine ten eleven twelve " * 4, "en")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string")
    one = C.dictionary(docs.limit(1), spacing=3)
    entries = C.dictionary(docs, spacing=3)
    assert entries.count() == one.count()
    n = entries.selectExpr("sum(own * times)").first()[0]
    assert n == 40 * 48


def test_counts_beyond_64_bits(spark):
    big = 3_000_000_000_000
    known = spark.createDataFrame(
        [("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, f bigint"
    )
    got = C.scored(known).first()
    assert got["score"] == 1000000 * (big - 1) ** 2 // (big * (big + 7))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert C.collocations(docs).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, "", "")], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        C.collocations(docs, longest=1)


def test_normalized():
    assert C.normalized(" A  b\t.\n ,C ;;\r d É ".encode()) == "a b\nc\nd É".encode()
    assert C.normalized(b" .\t, ") == b""
