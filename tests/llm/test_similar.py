import random

import pytest

from plugload.llm import similar


def brute_force(texts, similarity=0.8):
    sets = {i: similar.shingles((t or "").encode(), 5) for i, t in texts.items()}
    out, left = {}, sorted(sets)
    while left:
        start, front, left = left[0], [left[0]], left[1:]
        while front:
            at = front.pop()
            out[at] = start
            near = [x for x in left if len(sets[x] & sets[at]) >= similarity * len(sets[x] | sets[at]) - 1e-9]
            left = [x for x in left if x not in set(near)]
            front += near
    return out, sets


def shared(rnd, size, similarity):
    """Two texts of ``size`` shingles whose sets have about this similarity: one loses its end for other words."""
    words = [f"w{rnd.randrange(10**9)}" for _ in range(size + 4)]
    cut = round(size * (1 - similarity) / (1 + similarity))
    return " ".join(words), " ".join(words[: len(words) - cut] + [f"v{rnd.randrange(10**9)}" for _ in range(cut)])


def check(spark, texts, least=0.99):
    want, sets = brute_force(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    assert got.keys() == want.keys()
    assert all(want[i] == want[got[i]] for i in got), "no component joins texts that links do not join"
    assert sum(got[i] == want[i] for i in got) >= least * len(got)


def test_pairs_about_the_bound(spark):
    rnd = random.Random(5)
    texts = {}
    for k in range(1200):
        size = rnd.choice([6, 20, 60, 120, 400])
        for t in shared(rnd, size, 0.65 + 0.2 * (k % 101) / 100):
            texts[len(texts)] = t
    _, sets = brute_force({})
    want = {}
    for i in range(0, len(texts), 2):
        x, y = (similar.shingles(texts[i + k].encode(), 5) for k in (0, 1))
        want[i + 1] = i if len(x & y) >= 0.8 * len(x | y) - 1e-9 else i + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    links = {i for i in want if want[i] != i}
    assert 200 < len(links) < 1000
    assert all(got[i] == i for i in want if i not in links) and sum(got[i] == want[i] for i in links) >= 0.99 * len(links)


@pytest.mark.parametrize("block, nearest", [(2_048, 4), (60, 1)])
def test_copies_within_a_template(spark, monkeypatch, block, nearest):
    """Over 512 texts of one template, most pairs below 0.8, with true copies among them that no hub may keep apart."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    monkeypatch.setattr(similar, "FIRST_NEAREST", nearest)
    rnd = random.Random(11)
    base, texts = [f"t{i}" for i in range(200)], {}
    for k in range(300):
        own = base[:165] + [f"o{k}x{i}" for i in range(35)]  # 0.68 to each other
        twin = own[:-3] + [f"p{k}x{i}" for i in range(3)]
        for t in (own, twin) if k % 2 else (own, own[:190] + [f"q{k}x{i}" for i in range(2)]):
            texts[rnd.randrange(10**12)] = " ".join(t)
    for k in range(150):  # one group whose links are a chain
        texts[rnd.randrange(10**12)] = " ".join([f"c{i}" for i in range(4 * k, 4 * k + 120)])
    check(spark, texts)


def test_sets_decide_not_repeats(spark):
    line = "a line of several words that comes again and again "
    rest = " ".join(f"w{i}" for i in range(300))
    texts = {1: rest + " " + line, 2: rest + " " + line * 60, 3: "go " * 50, 4: "go " * 50 + "and then some quite other words follow"}
    check(spark, texts, 1)


@pytest.mark.parametrize("size", [30, 120, 500, 3000])
def test_screen_by_minima(size):
    """Sets at 0.8 pass, those at 0.7 mostly do not where there are some words."""
    import numpy as np

    rng, factors = np.random.default_rng(size), similar._constants()
    passed = {0.8: 0, 0.7: 0}
    for similarity in passed:
        common = round(size * 2 * similarity / (1 + similarity))
        common += similarity == 0.8 and common / (2 * size - common) < 0.8
        for _ in range(200):
            hashes = rng.integers(0, (1 << 64) - 1, 2 * size - common, np.uint64)
            sets = [np.sort(hashes[:size]), np.sort(hashes[size - common :])]
            words = [np.array([similar.sketch(s, *factors)[0]]) for s in sets]
            n = np.array([size])
            passed[similarity] += bool(similar.may_be_similar(n, words[0], n, words[1], 0.8)[0])
    assert passed[0.8] >= 199 and (passed[0.7] <= 40 or size < 100)


def test_templates_below_the_bound_are_hardly_verified(spark, monkeypatch):
    """Texts of one template, 0.7 to each other: twice the texts verify about twice the pairs, not four times."""
    asked = []
    real = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *rest: (asked.append(pairs.count()), real(pairs, *rest))[1])
    found = {}
    for n in (200, 400):
        asked.clear()
        base = [f"t{i}" for i in range(300)]
        rows = [(k, " ".join(base[:251] + [f"o{k}x{i}" for i in range(49)])) for k in range(n)]
        rows += [(10_000 + k, rows[k][1] + " end") for k in range(0, n, 10)]
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == {i: i - 10_000 if i >= 10_000 else i for i in got}
        found[n] = sum(asked)
    assert found[400] <= 3 * found[200] + 20 and found[400] <= 3 * 400


def test_pipeline_stage_links_by_fingerprints_first(spark, monkeypatch):
    """The stage asks the fingerprints; the sets still decide, and what the fingerprints miss is found by bands."""
    from corpus_pipeline import drop_near_duplicates
    from plugload.llm import simhash

    rnd = random.Random(3)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, base = {}, words(300)
    for k in range(40):
        own = words(300)
        texts[3 * k], texts[3 * k + 1] = " ".join(own), " ".join([*own[:-1], "end"])  # few bits apart
        texts[3 * k + 2] = " ".join([*own[:270], *words(30)])  # 0.81, many bits apart
    texts[1000], texts[1001] = " ".join(base * 1), " ".join([*base, *words(2) * 40])  # some bits apart, similarity decides
    asked, given = [], []
    links, verify = simhash.near_links, similar.verified
    monkeypatch.setattr(simhash, "near_links", lambda *a, **k: (asked.append(1), links(*a, **k))[1])
    monkeypatch.setattr(similar, "verified", lambda pairs, *rest: (given.append({tuple(r) for r in pairs.collect()}), verify(pairs, *rest))[1])
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want, _ = brute_force(texts)
    kept = {r["doc_id"] for r in drop_near_duplicates(spark, df, "").collect()}
    assert kept == {i for i in texts if want[i] == i}
    assert asked and sum((3 * k, 3 * k + 1) in given[0] for k in range(40)) >= 30
    assert all((3 * k, 3 * k + 1) not in pairs for k in range(40) for pairs in given[1:] if (3 * k, 3 * k + 1) in given[0])
