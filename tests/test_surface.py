"""Scalar functions, SQL steps, sources and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plugload.functions import columns as C
from plugload.plans.sqlsteps import run_statements
from plugload.settings import Settings
from plugload.sources import sinks
from plugload.sources.readings import (
    between, jdbc_options, parse_json, read_readings, readings_from_events, to_readings,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_round_half_up(spark):
    assert one(spark, C.round_half_up(F.lit(2.5), 0)) == 3.0
    assert one(spark, C.round_half_up(F.lit(-2.5), 0)) == -3.0
    assert one(spark, C.round_half_up(F.lit(1.005), 2)) == 1.01
    with pytest.raises(ValueError):
        C.round_half_up(F.lit(1.0), -1)


def test_suffixed(spark):
    assert one(spark, C.suffixed(F.lit("word"), times=2)) == "word!!!!!!"


def test_keys(spark):
    df = spark.createDataFrame([(1, 2, 3)], "house_id int, household_id int, plug_id int")
    assert tuple(df.select(C.plug_key(), C.member_key()).first()) == ("1_2_3", "2-3")


def test_latency(spark):
    assert one(spark, C.latency_ms(F.unix_millis(F.current_timestamp()) - 5)) == 5


def test_run_statements(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "k int, v double")
    steps = ["create or replace temp view t2 as select k, v + 1 as v from t1", "select k, sum(v) as s from t2 group by k"]
    assert {tuple(r) for r in run_statements(spark, {"t1": df}, steps).collect()} == {(1, 8.0), (2, 2.0)}
    with pytest.raises(ValueError):
        run_statements(spark, {}, [])


def test_jdbc_options():
    got = jdbc_options("jdbc:x://h/db", "archive", 0, 100, 4, {"user": "u"})
    assert got == {"user": "u", "url": "jdbc:x://h/db", "dbtable": "archive", "partitionColumn": "time_stamp",
                   "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x://h/db", "archive", 5, 5, 4)


def test_jdbc_writer(readings, monkeypatch):
    calls = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.jdbc", lambda self, *a, **k: calls.append((a, k)))
    sinks.jdbc_writer("jdbc:x://h/db", "archive", Settings(), staged=False, user="u")(readings([(1, 5, 1, 0, 0, 0)]), 0)
    assert calls == [(("jdbc:x://h/db", "archive"), {"mode": "append", "properties": {"user": "u", "batchsize": "5000"}})]


def test_archive_rows(readings):
    row = sinks.archive_rows(readings([(1, 5, 2, 7, 8, 9)])).first()
    assert row.asDict() == {"id": 1, "time_stamp": 5, "value": 2.0, "property": 1, "plug_id": 9, "household_id": 8, "house_id": 7}


def test_parse_json_drops_other_messages(spark):
    good = json.dumps({"id": 1, "ts_ms": 5, "value": 2.5, "property": 1, "plug_id": 0, "household_id": 0, "house_id": 3})
    raw = spark.createDataFrame([(good.encode(),), (b"no reading",), (b"{}",)], "value binary")
    assert [(r.id, r.house_id) for r in parse_json(raw).collect()] == [(1, 3)]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_file_formats(spark, readings, tmp_path, fmt):
    rows = readings([(1, 5, 2, 7, 8, 9), (2, 6, 3, 7, 8, 9)])
    rows.write.format(fmt).save(str(tmp_path / "x"))
    assert sorted(map(tuple, read_readings(spark, str(tmp_path / "x"), fmt).collect())) == sorted(map(tuple, rows.collect()))


def test_time_range_reaches_the_scan(spark, readings, tmp_path):
    readings([(i, i, 2, 7, 8, 9) for i in range(10)]).write.parquet(str(tmp_path / "x"))
    df = between(read_readings(spark, str(tmp_path / "x")), 3, 6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ms,3)" in plan and "LessThan(ts_ms,6)" in plan
    assert sorted(r.id for r in df.collect()) == [3, 4, 5]


def test_events_time_range(spark):
    start = int(dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc).timestamp() * 1000)
    df = readings_from_events(spark, "/root/testdata/sf0.001", start, start + 86_400_000)
    whole = readings_from_events(spark, "/root/testdata/sf0.001")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == between(whole, start, start + 86_400_000).count() > 0


def test_to_readings_casts(spark):
    df = spark.createDataFrame([("1", "5", "2.5", 1, 2, 3, 4)], "id string, ts_ms string, value string, property int, plug_id int, household_id int, house_id int")
    assert tuple(to_readings(df).first()) == (1, 5, 2.5, 1, 2, 3, 4)


def test_observation(readings):
    rows, seen = sinks.observation(readings([(i, i, 2, 7, 8, 9) for i in range(10)]), "results")
    rows.collect()
    assert seen.get == {"rows": 10}


def test_result_log(readings):
    rows = readings([(i, 100 - i, 2, 7, 8, 9) for i in range(10)])
    assert [r.id for r in sinks.result_log(rows, 4, ["ts_ms", "id"], Settings()).orderBy("row_no").collect()] == [6, 2]
