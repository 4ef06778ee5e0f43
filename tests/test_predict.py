from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plugload.functions.columns import slice_label
from plugload.operators import archive as A
from plugload.plans.predict import predict, predict_per_reading, running_average, slice_average
from plugload.schema import HOUSE, PLUG
from plugload.settings import DAY_MS, Settings
from plugload.sources.readings import slice_rows

MIN = 60_000
LIVE = 1378604640000
S = Settings(live_start_ms=LIVE)


def test_archive_starts():
    assert S.archive_start_ms == 1378518360000
    assert S.archive_start_ms - DAY_MS == 1378431960000


def test_slice_must_divide_a_day():
    with pytest.raises(ValueError):
        Settings(slice_ms=7 * MIN)
    with pytest.raises(ValueError):
        Settings(block_rows=1000)


def test_from_properties():
    s = Settings.from_properties({"live.start.time": "5", "slice.in.mins": "15", "number.of.archive.streams": "3", "x": "y"})
    assert (s.live_start_ms, s.slice_ms, s.start_days, s.history_days) == (5, 15 * MIN, 3, 29)


def test_slice_edges_and_gap(readings):
    rows = readings([
        (1, LIVE, 1, 0, 0, 0), (2, LIVE + MIN - 1, 3, 0, 0, 0), (3, LIVE + MIN, 10, 0, 0, 0),
        (4, LIVE + 4 * MIN, 7, 0, 0, 0), (5, LIVE + 5, 1000, 0, 0, 0, 0), (6, LIVE + 5, 50, 11, 0, 0),
        (7, LIVE - 1, 2, 0, 0, 0),
    ])
    got = {r.slice_idx: (r.current_load, r.readings_count) for r in slice_average(slice_rows(rows, replace(S, house_limit=10)), HOUSE, S).collect()}
    assert got == {0: (2.0, 2), 1: (10.0, 1), 4: (7.0, 1), -1: (2.0, 1)}


@pytest.mark.parametrize("s", [S, Settings(live_start_ms=LIVE, group_rows=1, window_rows=1, block_rows=2)])
def test_running_average(readings, s):
    rows = readings([(2, LIVE + 1, 4, 0, 0, 0), (1, LIVE + 1, 2, 0, 0, 1), (3, LIVE + 9, 9, 0, 1, 0), (4, LIVE + MIN, 8, 0, 0, 0)])
    house = {r.id: (r.current_load, r.readings_count) for r in running_average(slice_rows(rows, s), HOUSE, s).collect()}
    assert house == {1: (2.0, 1), 2: (3.0, 2), 3: (5.0, 3), 4: (8.0, 1)}
    plug = {r.id: r.current_load for r in running_average(slice_rows(rows, s), PLUG, s).collect()}
    assert plug == {1: 2.0, 2: 4.0, 3: 9.0, 4: 8.0}


def history(days, house=0, first_id=100):
    """One reading in the target slice (two ahead) on each of the given earlier days, value = day."""
    return [(first_id + d, LIVE + 2 * MIN - d * DAY_MS, d, house, 0, 0) for d in days]


@pytest.mark.parametrize("days, median", [([1], 1.0), ([1, 2], 1.5), ([1, 2, 3], 2.0), (range(1, 31), 15.0)])
def test_prediction(readings, days, median):
    # With 30 days the oldest one is outside the 29 days of history.
    rows = readings([(1, LIVE, 8, 0, 0, 0), (2, LIVE, 5, 1, 0, 0), *history(days)])
    for keys in (HOUSE, PLUG):
        got = predict(rows, keys, S).collect()
        assert [(r.house_id, r.slice_idx, r.target_slice) for r in got] == [(0, 0, 2)]
        assert got[0].history_median == median and got[0].predicted_load == (median + 8) / 2


def test_prediction_per_reading(readings):
    rows = readings([(1, LIVE, 8, 0, 0, 0), (2, LIVE + 1, 4, 0, 0, 1), *history([1])])
    got = {r.id: r.predicted_load for r in predict_per_reading(rows, HOUSE, S).collect()}
    assert got == {1: 4.5, 2: 3.5}


def test_morning_and_evening_stay_apart(readings):
    half = DAY_MS // 2
    rows = readings([(1, LIVE, 8, 0, 0, 0), (2, LIVE + half, 8, 0, 0, 0), *history([1]),
                     (3, LIVE + half + 2 * MIN - DAY_MS, 100, 0, 0, 0)])
    got = {r.slice_idx: r.history_median for r in predict(rows, HOUSE, S).collect()}
    assert got == {0: 1.0, half // MIN: 100.0}


def test_label(spark):
    # 2013-09-08 01:44 UTC
    got = spark.range(1).select(slice_label(F.lit(0), S).alias("a"), slice_label(F.lit(720), S).alias("b")).first()
    assert (got.a, got.b) == ("01:44 TO 01:45", "13:44 TO 13:45")


def test_weighted_average_is_raw_average(readings):
    rows = readings([(i, LIVE + i * 7000, i * i % 13, i % 2, i % 3, 0) for i in range(60)])
    rows = slice_rows(rows, S)
    weighted = {(r.house_id, r.slice_idx): (r.average_load, r.readings_count) for r in A.house_slices(A.plug_slices(rows, S)).collect()}
    raw = {(r.house_id, r.slice_idx): (r.current_load, r.readings_count) for r in slice_average(rows, HOUSE, S).collect()}
    assert weighted.keys() == raw.keys()
    assert all(weighted[k] == (pytest.approx(raw[k][0]), raw[k][1]) for k in raw)


def test_last_n(spark):
    per_day = S.slices_per_day
    averages = spark.createDataFrame([(0, -d * per_day + 5, float(d)) for d in range(1, 31)], "house_id int, slice_idx long, average_load double")
    got = A.last_n(averages, HOUSE, 29, S).collect()
    assert sorted(r.average_load for r in got) == [float(d) for d in range(1, 30)]
    lists = A.last_n_list(averages, HOUSE, 3, S).collect()
    assert [(r.house_id, r.slot, r.averages) for r in lists] == [(0, 5, [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("s", [S, Settings(group_rows=1, window_rows=1, block_rows=2)])
def test_punctuated_batches(spark, s):
    rows = [(0, 1, 5.0), (0, 2, 7.0), (0, 3, -1.0), (0, 4, -1.0), (0, 5, 9.0), (0, 6, -1.0), (0, 7, 4.0), (1, 1, 3.0)]
    df = spark.createDataFrame(rows, "k int, t int, v double").withColumn("marker", F.col("v") < 0)
    got = {(r.k, r.t): r.batch_no for r in A.punctuated_batches(df, "marker", ["k"], ["t"], s).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (0, 5): 3}
