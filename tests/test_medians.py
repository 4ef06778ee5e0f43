import random
from statistics import median, median_low

import pytest

from plugload.operators import medians as M
from plugload.operators.medians import (
    exact_median, grid_median, histogram, lower_median_of_histogram, reservoir_median, sketch_median,
)
from plugload.settings import Settings

BLOCKS = Settings(group_rows=1, window_rows=1, block_rows=4)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, 0 if i % 3 == 0 else rng.randrange(1, 6), rng.randrange(40) / 4, rng.randrange(10_000)) for i in range(400)]
    return data, spark.createDataFrame(data, "id long, k int, value double, ts_ms long").cache()


def groups(data):
    out = {}
    for _, k, v, _ in data:
        out.setdefault(k, []).append(v)
    return out


@pytest.mark.parametrize("s", [Settings(), BLOCKS])
def test_exact(rows, s):
    data, df = rows
    got = {r.k: (r["median"], r.n) for r in exact_median(df, ["k"], s).collect()}
    assert got == {k: (median(v), len(v)) for k, v in groups(data).items()}


@pytest.mark.parametrize("s", [Settings(), BLOCKS])
def test_exact_over_all(rows, s):
    data, df = rows
    assert exact_median(df, [], s).first()["median"] == median(r[2] for r in data)


@pytest.mark.parametrize("s", [Settings(), BLOCKS])
def test_lower(rows, s):
    data, df = rows
    got = {r.k: r["median"] for r in lower_median_of_histogram(histogram(df, ["k"]), ["k"], s).collect()}
    assert got == {k: median_low(v) for k, v in groups(data).items()}


def test_sketch(rows):
    data, df = rows
    got = {r.k: (r["median"], r.n) for r in sketch_median(df, ["k"]).collect()}
    assert got == {k: (median_low(v), len(v)) for k, v in groups(data).items()}
    # A coarse sketch stays within n / accuracy ranks.
    value, n = sketch_median(df, [], 20).first()
    below, upto = sum(r[2] < value for r in data), sum(r[2] <= value for r in data)
    assert below - n / 20 <= n / 2 <= upto + n / 20


def test_reservoir_of_everything_is_exact(rows):
    data, df = rows
    got = {r.k: (r["median"], r.n) for r in reservoir_median(df, ["k"], 1000, 1).collect()}
    assert got == {k: (median(v), len(v)) for k, v in groups(data).items()}


def test_reservoir_size_and_repeatability(rows):
    data, df = rows
    first = reservoir_median(df, [], 50, 7).first()
    assert first.n == 50
    assert first == reservoir_median(df.repartition(7), [], 50, 7).first()
    assert min(r[2] for r in data) <= first["median"] <= max(r[2] for r in data)


def test_reservoir_keeps_k_rows_before_the_shuffle(rows):
    plan = reservoir_median(rows[1], ["k"], 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("s", [Settings(), BLOCKS])
def test_grid(rows, s):
    data, df = rows
    got = {(r.k, r.window_end): r["median"] for r in grid_median(df, ["k"], 2000, 500, s).collect()}
    want = {}
    for _, k, v, t in data:
        for end in range((t // 500 + 1) * 500, (t // 500 + 1) * 500 + 2000, 500):
            want.setdefault((k, end), []).append(v)
    assert got == {key: median(v) for key, v in want.items()}


def test_slide_must_divide_width(rows):
    with pytest.raises(ValueError):
        grid_median(rows[1], ["k"], 2000, 300, Settings())


@pytest.mark.parametrize("keys", [[], ["house_id"]])
def test_grid_ends_over_blocks_of_time(spark, readings, keys):
    """Ends and counts over many blocks, with gaps at their borders; no window function without a partition."""
    width, slide = 4000, 1000
    block = M.GRID_WIDTHS * width
    times = [0, 1, 999, block - 4001, block - 1, block, block + 1, 2 * block - 3000, 2 * block + 3000, 5 * block + 500, 5 * block + 8500]
    rows = [(i, t, 1.0, i % 2, 0, 0) for i, t in enumerate(times)]
    got = M.grid_ends(readings(rows), keys, width, slide)
    want = {}
    for r in rows:
        for k in range(width // slide):
            end = (r[1] // slide + 1 + k) * slide
            key = (r[3], end) if keys else (end,)
            want[key] = want.get(key, 0) + 1
    assert sorted(map(tuple, got.collect())) == sorted((*k, n) for k, n in want.items())
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
