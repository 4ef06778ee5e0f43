import zlib

import numpy as np

from plugload.llm import factorization as Z, queries as Q

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, score string, _scored string, n_chars bigint"


def test_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in Q.op12_quality(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = ([rows[i]["score"] for i in labels if held(i) and labels[i] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean(np.array(good) >= 0.7) > 0.97 and np.mean(np.array(bad) >= 0.7) < 0.3


def test_sum_of_squares_identity():
    """The linear-time margin equals the sum over all pairs of features."""
    rng = np.random.default_rng(3)
    n = 40
    model = Z.Model(np.arange(10), np.zeros((2, 7)), 0.3, rng.normal(size=n), rng.normal(size=(n, 5)))
    rows = []
    for _ in range(20):
        f = rng.choice(n, int(rng.integers(1, 15)), replace=False)
        rows.append((f, rng.normal(size=len(f))))
    for got, (f, x) in zip(Z.margins(model, rows), rows):
        pairs = sum(model.factors[f[i]] @ model.factors[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(got - (0.3 + model.weights[f] @ x + pairs)) < 1e-9


def test_gradient_learns_an_interaction():
    """Class 1 where exactly one of two features is present: no linear score tells this."""
    rng = np.random.default_rng(0)
    rows, label = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        f = [0] + [1] * a + [2] * b
        rows.append((np.unique(f), np.ones(len(np.unique(f)))))
        label.append(float(a != b))
    bias, weights, factors = Z.fit_machine(rows, np.array(label), 3, epochs=60)
    model = Z.Model(np.arange(3), np.zeros((0, 7)), bias, weights, factors)
    assert ((Z.margins(model, rows) > 0) == np.array(label, bool)).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    words = ["bal", "rin", "tos", "mek", "lun", "dar", "sep"]
    text = lambda i: " ".join(rng.choice(words, 30)) + (" $$$ ###" if i % 4 == 0 else ".")
    rows = [(i, text(i), "s", "t", 100) for i in range(300)]
    odd = [(1000, None, "", "", None), (1001, "", "", "", None), (None, "bal rin.", "", "", 3), (1002, "rin " * 100_000, "", "", 1),
           (1002, "rin " * 100_000, "", "", 1), (1003, "\n\n", None, None, -5), (1004, "\x00", "", "", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(5000, 1), (None, 1), (3, None), (7, 0)], "doc_id bigint, quality int")
    model = Z.train(docs, labels, metadata=["n_chars"])
    got = Z.score(docs, model, ["n_chars"])
    assert got.columns == ["doc_id", "text", "_scored", "n_chars", "score"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert all((by_id[i][0] > 0.5) == (i % 4 > 0) for i in range(300))
    assert by_id[1000] == by_id[1001] and len(by_id[1002]) == 2 and len(set(by_id[1002])) == 1
    assert all(0 <= s <= 1 for x in by_id.values() for s in x)
    assert Z.score(docs.limit(0), model, ["n_chars"]).count() == 0
    again = Z.train(docs.repartition(7), labels.repartition(3), metadata=["n_chars"])
    assert (again.words == model.words).all() and np.array_equal(again.factors, model.factors) and again.bias == model.bias
    single = Z.train(docs, labels.where("quality = 1"))
    assert Z.score(docs, single).where("score > 0.5").count() == docs.count()
    none = Z.train(docs, labels.limit(0))
    assert Z.score_texts([b"a"], [[]], none).tolist() == [0.5]


def test_training_rows_are_bounded_and_fixed(spark):
    """At most the given number, although an id repeats; the same ones however the table is spread."""
    docs = spark.createDataFrame([(i % 900, f"text {i}") for i in range(3000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)] * 2, "doc_id bigint, quality int")
    some = [Z.training_rows(d, labels, "doc_id", "text", "quality", [], 500) for d in (docs, docs.repartition(9))]
    found = [sorted((r["hash"], r["label"], bytes(r["text"])) for r in x.collect()) for x in some]
    assert len(found[0]) == 500 and found[0] == found[1]


def test_word_counts():
    hashed = Z.Words(20)
    buckets, weight = hashed.counts([b"a", b"b", b"a", b"c"])
    assert len(buckets) == 3 and abs((weight**2).sum() - 1) < 1e-12
    values = np.sort(weight)
    assert abs(values[2] / values[0] - np.log(3) / np.log(2)) < 1e-12
    assert len(hashed.counts([])[0]) == 0
