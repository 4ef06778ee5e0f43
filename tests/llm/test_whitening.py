import numpy as np
import pytest

from plugload.llm import queries as Q, whitening as W

SF = "/root/testdata/sf0.001"


def naive(rows, k=16):
    """(n, deviation by id, eigenvalues, vectors, trace, centred) in plain numpy and Python integers."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    distinct = sorted(set(map(tuple, x.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in distinct])
    covariance = centred.T @ centred / n
    e, vectors = np.linalg.eigh(covariance)
    own = {i: np.array([(n * c - s) / n for c, s in zip(v, sums)]) for i, v in x.items()}
    return n, deviation, e[::-1][:k], vectors[:, ::-1][:, :k], np.trace(covariance), own


def compare(got, rows, k=16):
    n, deviation, e, vectors, trace, own = naive(rows, k)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert set(by_id) == {i for i, _ in rows}
    signs = None
    for i, found in by_id.items():
        found.sort(key=lambda r: r["component"])
        assert [r["component"] for r in found] == list(range(1, len(found) + 1))
        assert all(r["n"] == n and r["deviation"] == deviation[i] for r in found)
        want = own[i] @ vectors / np.sqrt(e)
        have = np.array([r["whitened"] for r in found])
        if signs is None:
            signs = {}
        for c, (a, b) in enumerate(zip(have, want)):
            if abs(b) > 1e-3:
                signs.setdefault(c, np.sign(a * b))
                assert abs(a * signs[c] - b) < 1e-6
        assert np.allclose([r["explained"] for r in found], e / trace, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]]
    compare(Q.op13_whitening(spark, SF).collect(), rows)


def test_odd_rows_and_any_partitioning(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6] + 1000).tolist()) for i in range(50)]
    good += [(100 + i, good[0][1]) for i in range(200)]  # copies weigh once
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [nan] * 6), (903, [inf] + [0.0] * 5), (904, []), (905, [1.0] * 5), (906, [1e300] * 6)]
    make = lambda parts: spark.createDataFrame(
        [(i, v, 1, "x") for i, v in good + bad], "vec_id bigint, embedding array<double>, component int, n string"
    ).repartition(parts)
    got = W.whitened(make(1)).collect()
    compare(got, good, 6)
    assert sorted(r[:6] for r in W.whitened(make(13)).collect()) == sorted(r[:6] for r in got)  # bit by bit
    assert W.whitened(make(1).limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert W.whitened(one).count() == 0 and W.whitened(one).columns[0] == "vec_id"
    two = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 9.0]), (None, [3.0, 9.0])], "vec_id string, embedding array<float>")
    found = W.whitened(two).collect()
    assert len(found) == 3 and all(abs(abs(r["whitened"]) - 1) < 1e-12 and r["explained"] > 1 - 1e-12 for r in found)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**44 + 3 * i), float(-(2**45) + i * i), float(i)]) for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    _, deviation, *_ = naive(rows)
    assert {r["vec_id"]: int(r["deviation"]) for r in W.whitened(table).collect()} == deviation


@pytest.mark.parametrize("values", [
    [5.0], [3, 3, 3, 2, 2, 1], [1] * 20, [7, 7 - 1e-13, 7 - 2e-13, 1, 1e-6, 1e-9], np.linspace(1, 2, 40), [4, 0, 0, 0], [1e-8, 1e-9, 1e-10], [1e12, 5, 5, 3],
])
def test_spectrum(values):
    """Values, vectors and certified bounds, with equal, close, zero and widely spread eigenvalues."""
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    matrix = q * np.array(values, float) @ q.T
    matrix = (matrix + matrix.T) / 2
    s = W.leading(matrix)
    want = np.linalg.eigvalsh(matrix)[::-1]
    k = len(s.values)
    assert k == min(16, int((want > 1e-12 * want[0]).sum()))
    assert np.abs(s.values - want[:k]).max() < 1e-13 * want[0]
    assert (s.lower < s.values).all() and (s.values < s.upper).all()
    assert np.abs(s.vectors.T @ s.vectors - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ s.vectors - s.vectors * s.values).max() < 1e-13 * want[0]


def test_counts_follow_inertia():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(25, 25))
    a = a + a.T
    diagonal, off = W.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    for shift in [*np.linspace(values[0] - 1, values[-1] + 1, 50)]:
        assert W.positives(diagonal.tolist(), [0.0, *(off * off).tolist()], shift, 1e-300) == (values > shift).sum()
    assert W.leading(np.zeros((4, 4))).values.size == 0
