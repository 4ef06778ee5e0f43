"""Nulls, pruning, table folders, long streams, packaging."""

import os
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plugload.operators import archive as A
from plugload.operators.blocks import running
from plugload.operators.medians import grid_ends, grid_median
from plugload.plans import outliers as O, predict as P
from plugload.plans.sqlsteps import run_statements
from plugload.schema import HOUSE, PLUG, READING
from plugload.settings import Settings
from plugload.sources import readings as R, sinks
from plugload.streaming import queries as S

HOUR = 3_600_000
DAY = 24 * HOUR
LIVE = 240 * HOUR
CONF = Settings(live_start_ms=LIVE, slice_ms=HOUR, window_ms=2 * HOUR, watermark_ms=60_000)
REPO = Path(__file__).resolve().parents[1]


def nullable(spark, rows):
    return spark.createDataFrame([(i, t, v, 1, p, 0, h) for i, t, v, h, p in rows], READING)


def test_blocks_and_windows_agree_on_nulls(spark):
    rows = [(1, i, v) for i, v in enumerate([2.0, 4.0, None, None, None, 6.0])] + [(2, i, v) for i, v in enumerate([None, None, None, 1.0])]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    want = None
    for s in (Settings(), replace(Settings(), window_rows=1, block_rows=2)):
        got = sorted(running(df, ["k"], ["t"], s, sums={"total": F.col("v")}).select("k", "t", "total").collect())
        want = want or got
        assert got == want
    assert [r["total"] for r in want] == [2, 6, 6, 6, 6, 12, None, None, None, 1]


def test_averages_skip_missing_values(spark):
    df = nullable(spark, [(1, LIVE, 2.0, 0, 0), (2, LIVE + 1, None, 0, 0), (3, LIVE + 2, 4.0, 0, 0), (4, LIVE + 3, float("nan"), 0, 1)])
    rows = R.slice_rows(df, CONF)
    running_avg = {r["id"]: (r["current_load"], r["readings_count"]) for r in P.running_average(rows, HOUSE, CONF).collect()}
    assert running_avg == {1: (2.0, 1), 2: (2.0, 2), 3: (3.0, 3), 4: (3.0, 4)}
    assert P.slice_average(rows, HOUSE, CONF).first()["current_load"] == 3.0
    house = A.house_slices(A.plug_slices(rows, CONF)).first()
    assert (house["average_load"], house["readings_count"]) == (3.0, 4)


def test_windows_without_value_give_no_flag(spark):
    rows = [(1, LIVE, 1.0, 0, 0), (2, LIVE, 5.0, 0, 1), (3, LIVE + 3 * HOUR, None, 0, 0), (4, LIVE + 6 * HOUR, 5.0, 0, 0), (5, LIVE + 6 * HOUR, 1.0, 0, 1)]
    got = O.percentages(O.flag_changes(O.plug_flags(nullable(spark, rows), CONF), ["ts_ms"], CONF), ["ts_ms", "id"], CONF).collect()
    assert max(r["plug_count"] for r in got) == 2 and {r["percentage"] for r in got} == {0.0, 50.0, 100.0}


def test_no_house_is_left_out_unless_asked(spark):
    df = nullable(spark, [(i, LIVE, 1.0, i, 0) for i in range(40)])
    assert R.slice_rows(df, Settings()).count() == 40 and R.slice_rows(df, Settings(house_limit=10)).count() == 10


def test_history_starts_with_few_days_and_grows():
    s = Settings.from_properties({"number.of.archive.streams": "3"})
    assert (s.start_days, s.history_days) == (3, 29)


def test_grid_medians_need_no_copies(spark):
    """A day's windows by the minute: each reading is in 1,440 windows, and rows before the last step stay few."""
    rows = [(i, LIVE + i * 7 * 60_000, float(i % 13), 0, i % 2) for i in range(50)]
    df = nullable(spark, rows)
    got = {(r["plug_id"], r["window_end"]): (r["median"], r["n"]) for r in grid_median(df, PLUG, DAY, 60_000, CONF).select("plug_id", "window_end", "median", "n").collect()}
    assert len(got) == grid_ends(df, PLUG, DAY, 60_000).count()
    for plug in (0, 1):
        own = [(t, v) for _, t, v, _, p in rows if p == plug]
        for end in range(LIVE + 60_000, LIVE + DAY + 50 * 7 * 60_000, 11 * 60_000):
            inside = sorted(v for t, v in own if end - DAY <= t < end)
            if inside:
                middle = (inside[(len(inside) - 1) // 2] + inside[len(inside) // 2]) / 2
                assert got[plug, end] == (middle, len(inside))
    with pytest.raises(ValueError):
        grid_ends(df, PLUG, DAY, 7 * HOUR)


def test_pane_state_is_one_row_per_value(spark, tmp_path):
    rows = [(i, LIVE + i * 60_000, float(i % 3), 0, 0) for i in range(300)]
    nullable(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    conf = CONF.with_window(DAY)
    query = S.stream_outliers(R.stream_readings(spark, str(tmp_path / "in")), 60_000, conf, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination()
    state = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    assert state <= 300
    with pytest.raises(ValueError):
        S.pane_histogram(R.stream_readings(spark, str(tmp_path / "in")), 7 * HOUR, conf)


def test_many_batches_leave_bounded_tables(spark, tmp_path):
    """Each restart is a micro-batch; the tables are tidied and the results are those of one batch job."""
    conf = Settings(live_start_ms=LIVE, slice_ms=6 * HOUR, window_ms=12 * HOUR, watermark_ms=60_000, history_days=2, start_days=2)
    rows = [(i, LIVE - DAY + i * 20 * 60_000, float(i * 37 % 101), i % 2, i % 3) for i in range(72 * 4)]
    src, out, pred = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "pred")
    S.prepare_history(nullable(spark, rows), HOUSE, conf, pred)
    live = [r for r in rows if r[1] >= LIVE]
    for k in range(0, len(live), 18):
        nullable(spark, live[k : k + 18]).coalesce(1).write.mode("append").parquet(str(src))
        stream = R.stream_readings(spark, str(src))
        S.stream_outliers(stream, 6 * HOUR, conf, out, str(tmp_path / "s1"), available_now=True).awaitTermination()
        S.stream_prediction(stream, HOUSE, conf, pred, str(tmp_path / "s2"), available_now=True).awaitTermination()
    count = lambda folder: len(list(Path(folder).iterdir())) if Path(folder).exists() else 0
    assert count(f"{out}/flags") <= 2 and count(f"{out}/kept") <= 2 and count(f"{out}/histogram") <= 2 and count(f"{out}/panes") <= 2 and count(f"{out}/nodes") <= 5
    days = [p for p in Path(pred, "averages").iterdir() if p.name.startswith("day=")]
    assert len(days) <= conf.history_days + 2
    last = rows[-1][1] - conf.watermark_ms
    columns = [*HOUSE, "slice_idx", "current_load", "predicted_load"]
    want = P.predict(nullable(spark, rows), HOUSE, conf).where((F.col("slice_idx") + 1) * conf.slice_ms + LIVE <= last)
    got = spark.read.parquet(f"{pred}/predictions").select(*columns)
    assert sorted(got.collect()) == sorted(want.select(*columns).collect()) and got.count() > 5
    columns = [*PLUG, "window_end", "flag", "above_count", "plug_count", "percentage"]
    want = O.grid_outliers(nullable(spark, live), 6 * HOUR, conf).where(F.col("window_end") <= last).select(*columns)
    assert sorted(spark.read.parquet(f"{out}/changes").select(*columns).collect()) == sorted(want.collect())


def test_any_reading_closes_slices(spark, tmp_path):
    rows = [(1, LIVE + 5, 10.0, 1, 0, 0, 0), (2, LIVE + 3 * HOUR, 1.0, 0, 0, 0, 20)]
    spark.createDataFrame(rows, READING).coalesce(1).write.parquet(str(tmp_path / "in"))
    S.prepare_history(nullable(spark, [(9, LIVE - 22 * HOUR, 30.0, 0, 0)]), HOUSE, CONF, str(tmp_path / "out"))
    S.stream_prediction(R.stream_readings(spark, str(tmp_path / "in")), HOUSE, CONF, str(tmp_path / "out"), str(tmp_path / "s"), available_now=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/predictions")
    row = got.first()
    assert row["slice_idx"] == 0 and row["predicted_load"] == 20.0
    assert sinks.with_latency(got).first()["latency_ms"] >= 0


def test_archive_days_are_pruned(spark, tmp_path):
    df = nullable(spark, [(i, LIVE + i * DAY, 1.0, 0, 0) for i in range(5)])
    sinks.with_day_folder(df).write.partitionBy("day").parquet(str(tmp_path / "archive"))
    part = R.read_archive(spark, str(tmp_path / "archive"), LIVE + DAY, LIVE + 2 * DAY)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts_ms" in plan
    assert [r["id"] for r in part.collect()] == [1] and part.columns == [f.name for f in READING.fields]


def test_prediction_reads_only_the_history_it_needs(spark, tmp_path):
    nullable(spark, [(1, LIVE, 1.0, 0, 0)]).write.parquet(str(tmp_path / "r"))
    plan = P.predict(R.read_readings(spark, str(tmp_path / "r")), HOUSE, CONF)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(ts_ms,{CONF.history_start_ms})" in plan


def test_malformed_rows_are_dropped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":1,"ts_ms":5,"value":1.5,"property":1,"plug_id":0,"household_id":0,"house_id":0}\nnot json\n{"id":2}\n')
    (tmp_path / "b.csv").write_text("1,5,1.5,1,0,0,0\nx,y,z\n")
    assert R.read_readings(spark, str(tmp_path / "a.json"), "json").count() == 1
    assert R.read_readings(spark, str(tmp_path / "b.csv"), "csv").count() == 1


@pytest.mark.parametrize("name", ["persist_roundtrip", "stream_q1a", "stream_q2a"])
def test_streams_read_table_folders(spark, tmp_path, name):
    import __spark_entry__ as entry

    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    query = entry.queries()[name]
    got = query(spark, str(tmp_path)).collect()
    assert got and sorted(map(repr, got)) == sorted(map(repr, query(spark, source).collect()))


def test_jdbc_options_and_staged_batches(spark):
    assert R.jdbc_query_options("u", "select 1") == {"url": "u", "query": "select 1"}
    split = R.jdbc_query_options("u", "select 1", "id", (0, 100), 8)
    assert split["dbtable"] == "(select 1) q" and split["numPartitions"] == "8" and "query" not in split
    with pytest.raises(ValueError):
        R.jdbc_query_options("u", "select 1", "id", (5, 5))
    calls = []

    class Writer:
        def jdbc(self, *args, **kwargs):
            calls.append((args, kwargs["mode"]))

    class Frame:
        write = Writer()
        withColumnRenamed = select = lambda self, *_: self

    for _ in range(2):
        sinks.jdbc_writer("u", "t", Settings())(Frame(), 7)
    sinks.jdbc_writer("u", "t", Settings(), staged=False)(Frame(), 7)
    assert calls == [(("u", "t_7"), "overwrite")] * 2 + [(("u", "t"), "append")]


def test_statements_leave_the_sessions_views_alone(spark):
    spark.range(3).createOrReplaceTempView("readings")
    got = run_statements(spark, {"readings": spark.range(5)}, ["create or replace temp view step as select id from readings", "select count(*) n from step"])
    assert got.first()["n"] == 5 and spark.table("readings").count() == 3
    assert not spark.catalog.tableExists("step")
    spark.catalog.dropTempView("readings")


def test_executors_need_no_installed_package(tmp_path):
    """A session started in another folder, whose Python workers cannot import the package."""
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["plug_median_1h"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 8" in done.stdout or int(done.stdout.split("rows ")[1].split()[0]) > 100, done.stderr[-2000:]
