import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings as hyp, strategies as st

from plugload.functions.ranks import select_in_ranges
from plugload.operators import sliding
from plugload.operators.sliding import sliding_median
from plugload.settings import Settings

WIDTH = 3000


@given(
    st.lists(st.tuples(st.integers(0, 30), st.integers(1, 4)), min_size=1, max_size=40),
    st.integers(0, 39), st.integers(1, 40), st.integers(0, 200),
)
@hyp(max_examples=200, deadline=None)
def test_select_in_ranges(points, lo, length, k):
    codes, weights = (np.array(c, dtype=np.int64) for c in zip(*points))
    lo = min(lo, len(codes) - 1)
    hi = min(lo + length, len(codes))
    flat = np.sort(np.repeat(codes[lo:hi], weights[lo:hi]))
    k = k % len(flat)
    got = select_in_ranges(codes, weights, np.array([lo]), np.array([hi]), np.array([k]))
    assert got[0] == flat[k]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 1500
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 8, n))
    # A third of the rows share a millisecond; values drift with time, so that the median moves through the bins.
    ts = 1_000_000 + np.where(rng.random(n) < 0.33, 5000, rng.integers(0, 20000, n))
    value = np.round(rng.gamma(2, 3, n) + ts / 4000, 1)
    value[::50] = 250.0
    value[7::60] = np.nan
    pdf = pd.DataFrame({"k": key.astype("int32"), "ts_ms": ts, "value": value, "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def brute(pdf, keys):
    out = {}
    key, ts, value = pdf["k"].to_numpy(), pdf["ts_ms"].to_numpy(), pdf["value"].to_numpy()
    for i in range(len(pdf)):
        seen = (ts > ts[i] - WIDTH) & (ts <= ts[i])
        if keys:
            seen &= key == key[i]
        here = seen & (ts == ts[i])
        out[(*([key[i]] if keys else []), ts[i])] = (np.nanmedian(value[seen]) if (~np.isnan(value[seen])).any() else np.nan, pdf["id"].to_numpy()[here].min())
    return out


# group_rows 500 splits: the large key goes through blocks, the others do not.
@pytest.mark.parametrize("group_rows, block_rows", [(10_000, 1 << 20), (500, 64), (1, 16)])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_against_brute_force(data, keys, group_rows, block_rows):
    pdf, df = data
    got = sliding_median(df, keys, WIDTH, Settings(group_rows=group_rows, block_rows=block_rows)).collect()
    want = brute(pdf, keys)
    assert len(got) == len(want)
    for r in got:
        median, first = want[(*(r[k] for k in keys), r.ts_ms)]
        assert (np.nan if r["median"] is None else r["median"]) == pytest.approx(median, nan_ok=True) and r.first_id == first


def test_window_edges(readings):
    hour = 3_600_000
    # The window is (t - 1 h, t]: exactly one hour back is out, one millisecond less is in.
    rows = readings([(1, hour, 10, 0, 0, 0), (2, 2 * hour - 1, 20, 0, 0, 0), (3, 2 * hour, 40, 0, 0, 0)])
    got = {r.ts_ms: r["median"] for r in sliding_median(rows, ["house_id"], hour, Settings()).collect()}
    assert got == {hour: 10.0, 2 * hour - 1: 15.0, 2 * hour: 30.0}


def test_same_millisecond_and_nulls(spark):
    rows = [(1, 1000, 1.0), (2, 1000, 5.0), (3, 1000, None), (4, 9_000_000, None)]
    df = spark.createDataFrame(rows, "id long, ts_ms long, value double")
    got = {r.ts_ms: (r["median"], r.first_id) for r in sliding_median(df, [], 3_600_000, Settings()).collect()}
    assert got[1000] == (3.0, 1)
    assert got[9_000_000] == (None, 4)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, ts_ms long, value double")
    assert sliding_median(df, [], 1000, Settings()).count() == 0


def test_even_median_is_half_of_the_sum(readings):
    """A last-bit difference would flip "above" where both medians come from the same two values."""
    pairs = [(i / 1000, j / 1000) for i in range(1, 200, 7) for j in range(i, 4000, 611)]
    rows = [(2 * n + side, 10_000_000 * n, pair[side], 0, 0, 0) for n, pair in enumerate(pairs) for side in (0, 1)]
    got = {r.ts_ms: r["median"] for r in sliding_median(readings(rows), [], 3_600_000, Settings()).collect()}
    assert got == {10_000_000 * n: (a + b) / 2 for n, (a, b) in enumerate(pairs)}


def counted_answers(spark, monkeypatch, most):
    """Counts the Python groups; one of more than ``most`` rows fails."""
    real, groups = sliding._answer, spark.sparkContext.accumulator(0)

    def counting(*args):
        answer = real(*args)

        def run(pdf):
            groups.add(1)
            if len(pdf) > most:
                raise ValueError(f"{len(pdf)} rows in one Python group")
            return answer(pdf)

        return run

    monkeypatch.setattr(sliding, "_answer", counting)
    return groups


def test_small_blocks_share_groups_and_cells_stay_below_the_rows(data, spark, monkeypatch):
    pdf, df = data
    groups = counted_answers(spark, monkeypatch, 1 << 20)
    got = sliding_median(df, [], WIDTH, Settings(group_rows=1, block_rows=16)).collect()
    want = brute(pdf, [])
    assert all(r["median"] == pytest.approx(want[(r.ts_ms,)][0], nan_ok=True) for r in got) and len(got) == len(want)
    assert 0 < groups.value <= 16
    for rows in (1, 100, 10_000, 10**7, 10**10):
        assert (rows / sliding.dense_block_rows(rows, Settings(block_rows=16))) ** 2 <= rows


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_python_groups_are_bounded(data, spark, monkeypatch, keys):
    """Whatever group_rows allows, a span above SPAN_ROWS is cut and packs have about PACK_ROWS rows."""
    pdf, df = data
    monkeypatch.setattr(sliding, "SPAN_ROWS", 256, raising=False)
    monkeypatch.setattr(sliding, "PACK_ROWS", 128)
    counted_answers(spark, monkeypatch, 1000)
    got = sliding_median(df, keys, WIDTH, Settings()).collect()
    want = brute(pdf, keys)
    assert len(got) == len(want)
    assert all((np.nan if r["median"] is None else r["median"]) == pytest.approx(want[(*(r[k] for k in keys), r.ts_ms)][0], nan_ok=True) for r in got)
