from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np

import corpus_pipeline as C
from plugload.llm import queries as Q, toxicity as T
from plugload.session import materialized
from tests.llm.test_quality_simhash_mixing import naive_targets, split
from tests.llm.test_similar import brute_force
from tests.llm.test_substrings import naive
from tests.llm.test_toxicity_packing import check_pieces

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark):
    """The stages one by one, each against a plain version over the rows its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(C.STAGES)

    clean = materialized(stages["toxicity"](spark, docs, SF))
    model = Q.toxicity_model(spark, SF)
    rows = docs.collect()
    scores = T.score_texts([r["text"] or "" for r in rows], model)
    assert Counter(clean.collect()) == Counter(r for r, s in zip(rows, scores) if s < 0.5) and clean.columns == columns

    single = materialized(stages["simhash_near_dedup"](spark, clean, SF))
    rows = clean.collect()
    groups, _ = brute_force({r["doc_id"]: r["text"] for r in rows})
    assert Counter(single.collect()) == Counter(r for r in rows if groups[r["doc_id"]] == r["doc_id"]) and single.columns == columns

    cut = materialized(stages["suffix_array_dedup"](spark, single, SF))
    rows = single.collect()
    want = naive([(r["text"] or "").encode() for r in rows], 200)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and len(got) == len(rows)
    for r, (size, removed, _, digest) in zip(rows, want):
        kept = got[r["doc_id"]]
        if removed == 0:
            assert kept == r
        else:
            assert len(kept["text"]) == kept["n_chars"] and len(kept["text"].encode()) <= size - removed
            assert len(kept["text"].encode()) < size - removed or sha256(kept["text"].encode()).hexdigest() == digest

    mixed = materialized(stages["mixing"](spark, cut, SF))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in cut.collect():
        sizes[r["source"]] += len(split(r["text"]))
    for r in mixed.collect():
        taken[r["source"]] += len(split(r["text"]))
    targets = naive_targets(sizes)
    assert mixed.columns == columns and all(abs(taken[s] - t) <= 1 for s, t in targets.items())

    padding, _ = check_pieces(mixed, stages["packing"](spark, mixed, SF).collect())
    assert padding < 0.05


def test_whole_run_repeats(spark):
    first, second = (C.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect() for _ in range(2))
    assert Counter(first) == Counter(second) and first


def test_odd_documents_pass_all_stages(spark):
    rng = np.random.default_rng(0)
    words = lambda n: " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], n))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "", "en", "a", 0), (4, "one", "en", None, 3), (None, "no id " * 3, "en", "b", 18),
            (5, words(30_000), "en", "b", 0), (6, "same text of some words here", "en", "b", 0), (6, "same text of some words here", "en", "b", 0), (7, "same text of some words here", "en", "c", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, removed int, row string, _score string"
    docs = spark.createDataFrame([(*r, 1, "r", "t") for r in rows], schema)
    for start in (docs, docs.limit(0)):
        at = start
        for _, stage in C.STAGES[:-1]:
            at = materialized(stage(spark, at, SF))
            assert at.columns == docs.columns
        assert (C.pack_sequences(spark, at, SF).count() > 0) == (start is docs)
    assert at.count() == 0
