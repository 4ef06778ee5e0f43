import random

import pytest
from pyspark.sql import functions as F

from plugload.operators.blocks import largest_group, row_numbers, running, sample_every_n
from plugload.settings import Settings

PLAIN, BLOCKS = Settings(), Settings(group_rows=1, window_rows=1, block_rows=8)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # One key holds a third of all rows, and one time of that key a third of these.
    data = [(0 if i % 3 == 0 else rng.randrange(1, 9), 7 if i % 9 == 0 else rng.randrange(500), i, rng.randrange(10)) for i in range(900)]
    return data, spark.createDataFrame(data, "k int, t int, id int, v int").repartition(5)


def expected(data):
    total, last, out = {}, {}, {}
    for k, t, i, v in sorted(data):
        total[k] = total.get(k, 0) + v
        out[i] = (total[k], last.get(k))
        last[k] = v
    return out


@pytest.mark.parametrize("s", [PLAIN, BLOCKS])
def test_running(rows, s):
    data, df = rows
    got = running(df, ["k"], ["t", "id"], s, sums={"total": F.col("v")}, previous={"before": F.col("v")})
    assert got.columns == ["k", "t", "id", "v", "total", "before"]
    assert {r.id: (r.total, r.before) for r in got.collect()} == expected(data)


def test_largest_group(rows):
    data, df = rows
    assert largest_group(df, ["k"]) == max(sum(r[0] == k for r in data) for k in range(9))
    assert largest_group(df, []) == 900
    assert largest_group(df.where("false"), ["k"]) == 0


def test_row_numbers(rows):
    data, df = rows
    order = [r[2] for r in sorted(data, key=lambda r: (r[1], r[2]))]
    got = row_numbers(df, ["t", "id"], BLOCKS).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.row_no)] == order
    assert sorted(r.row_no for r in got) == list(range(1, 901))


def test_sample_every_n(rows):
    data, df = rows
    order = [r[2] for r in sorted(data, key=lambda r: (r[1], r[2]))]
    got = sample_every_n(df, 100, ["t", "id"], BLOCKS).orderBy("row_no").collect()
    assert [r.id for r in got] == order[99::100]
    with pytest.raises(ValueError):
        sample_every_n(df, 0, ["t"], BLOCKS)


def test_no_cross_join_or_single_partition(rows):
    plan = running(rows[1], ["k"], ["t", "id"], BLOCKS, sums={"x": F.col("v")})._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
