"""Registered queries over the driver tables and their DuckDB counterparts.

The ``events`` table stands in for smart-plug readings, see ``readings_from_events``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plugload.functions import columns as C
from plugload.operators import archive as A, medians as M
from plugload.operators.blocks import sample_every_n
from plugload.plans import outliers as O, predict as P
from plugload.plans.sqlsteps import run_statements
from plugload.schema import HOUSE, PLUG
from plugload.session import materialized, new_folder
from plugload.settings import DAY_MS, Settings
from plugload.sources import sinks
from plugload.sources.readings import (
    load_only,
    read_archive,
    readings_from_events,
    slice_rows,
    stream_readings_from_events,
    with_event_time,
)
from plugload.streaming import continuous as K, keyed, queries as S
from plugload.streaming.tables import Tables, follow_turns, write_turns

HOUR_MS = 3_600_000
# 6-hour slices and live data from 2024-01-23 00:00 UTC suit the density of the driver tables.
SETTINGS = Settings(live_start_ms=1705968000000, slice_ms=6 * HOUR_MS)
SAMPLE_SEED = 42
# Rows of a micro-batch of a large table that is streamed in turns.
TURN_ROWS = 1 << 20
# So small that the driver tables go through the plans for groups that do not fit into one task.
SMALL = replace(SETTINGS, group_rows=20, window_rows=200, block_rows=32)
SMALL_WINDOWS = replace(SETTINGS, window_rows=2, block_rows=8)
SMALL_DAYS = replace(SETTINGS, group_rows=200, window_rows=200, block_rows=64)


# The operators of the training-data pipeline are an optional part.
_extra = importlib.import_module("plugload.llm.queries") if find_spec("plugload.llm") else None
_pipeline = importlib.import_module("corpus_pipeline") if _extra and find_spec("corpus_pipeline") else None


def entry(spark: SparkSession) -> DataFrame:
    """Predicted load per house and slice."""
    return queries()["q1a_predict_house"](spark, "/root/testdata/sf0.001")


def _six(value: Column) -> Column:
    """Six places. Both engines round a decimal, so that ties do not depend on the last bit of a double."""
    return F.round(value.cast("decimal(38,9)"), 6).cast("double")


def _r(name: str) -> Column:
    return _six(F.col(name)).alias(name)


def _load_readings(spark: SparkSession, d: str) -> DataFrame:
    return load_only(readings_from_events(spark, d))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return slice_rows(readings_from_events(spark, d), SETTINGS)


def _plugs(spark: SparkSession, d: str) -> DataFrame:
    return A.plug_slices(_rows(spark, d), SETTINGS)


def _holey(spark: SparkSession, d: str) -> DataFrame:
    """The readings with every seventh value missing and every eleventh not a number."""
    value = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    return readings_from_events(spark, d).withColumn("value", value)


def _house_limited(spark, d):
    """The archive slices of the first houses only."""
    rows = slice_rows(readings_from_events(spark, d), replace(SETTINGS, house_limit=10))
    return A.plug_slices(rows, SETTINGS).select(*PLUG, "slice_idx", _r("average_load"), "readings_count")


def _archive_plug_slice(spark, d):
    return _plugs(spark, d).select(*PLUG, "slice_idx", _r("average_load"), "readings_count")


def _archive_window_scan(spark, d):
    """The archive day slices that belong to the first live slice: only their time range is read."""
    start = SETTINGS.archive_start_ms - (SETTINGS.history_days - 1) * DAY_MS
    end = SETTINGS.archive_start_ms + SETTINGS.slice_ms
    rows = slice_rows(readings_from_events(spark, d, start, end), SETTINGS)
    plugs = A.with_day_and_slot(A.plug_slices(rows, SETTINGS), SETTINGS)
    wanted = plugs.where(F.col("slot") == SETTINGS.lookahead_slices % SETTINGS.slices_per_day)
    return wanted.select(
        *PLUG, _r("average_load"), "readings_count", (-F.col("day")).alias("day_count"),
        C.slice_label(F.col("slice_idx"), SETTINGS).alias("time_slice"),
    ).orderBy(*PLUG, "day_count")


def _archive_house(spark, d):
    return A.house_slices(_plugs(spark, d)).select(*HOUSE, "slice_idx", _r("average_load"), "readings_count")


def _archive_last_n(spark, d):
    latest = A.last_n(A.house_slices(_plugs(spark, d)), HOUSE, SETTINGS.history_days, SETTINGS)
    return latest.select(*HOUSE, "slot", "day", "age", _r("average_load"))


def _history_median(keys):
    def run(spark, d):
        averages = P.key_averages(_rows(spark, d), keys, SETTINGS)
        medians = A.history_of_live(averages, keys, SETTINGS)
        return medians.select(*keys, "target_slice", _r("history_median"), "history_count")

    return run


def _running_avg(keys, settings=SETTINGS, source=readings_from_events):
    def run(spark, d):
        rows = P.running_average(slice_rows(source(spark, d), settings), keys, settings)
        return rows.select("id", *keys, "slice_idx", _r("current_load"), "readings_count")

    return run


def _slice_avg(keys):
    def run(spark, d):
        rows = P.slice_average(_rows(spark, d), keys, SETTINGS)
        return rows.select(*keys, "slice_idx", _r("current_load"), "readings_count")

    return run


def _predict(keys, per_reading=False):
    def run(spark, d):
        plan = P.predict_per_reading if per_reading else P.predict
        result = plan(readings_from_events(spark, d, SETTINGS.history_start_ms), keys, SETTINGS)
        head = ["id", *keys] if per_reading else list(keys)
        key = [C.plug_key().alias("plug_key")] if keys == PLUG else []
        return result.select(*head, *key, "slice_idx", "time_slice", _r("current_load"), _r("predicted_load"))

    return run


def _global_median(width, settings=SETTINGS):
    def run(spark, d):
        medians = O.global_median(readings_from_events(spark, d), settings.with_window(width))
        return medians.select("ts_ms", _r("global_median"))

    return run


def _plug_median(width):
    def run(spark, d):
        medians = O.plug_median(readings_from_events(spark, d), SETTINGS.with_window(width))
        return medians.select(*PLUG, "ts_ms", _r("plug_median"))

    return run


def _reading_with_global_median(spark, d):
    rows = O.with_global_median(readings_from_events(spark, d), SETTINGS)
    return rows.select("id", *PLUG, "ts_ms", "value", _r("global_median"))


def _global_median_grid(spark, d):
    grid = M.grid_median(_load_readings(spark, d), [], HOUR_MS, HOUR_MS // 4, SETTINGS)
    return grid.select("window_end", _r("median"), "n")


def _exact_median_house(spark, d):
    return M.exact_median(_load_readings(spark, d), HOUSE, SETTINGS).select(*HOUSE, _r("median"), "n")


def _reservoir(keys, k):
    def run(spark, d):
        return M.reservoir_median(_load_readings(spark, d), keys, k, SAMPLE_SEED).select(*keys, _r("median"), "n")

    return run


def _sketch_median_house(spark, d):
    return M.sketch_median(_load_readings(spark, d), HOUSE).select(*HOUSE, "median", "n")


def _hist_lower_median(spark, d):
    return M.lower_median(_load_readings(spark, d), HOUSE, SETTINGS).select(*HOUSE, "median", "n")


def _plug_flag_changes(spark, d):
    flags = O.plug_flags(readings_from_events(spark, d), SETTINGS)
    changes = O.flag_changes(flags, ["ts_ms"], SETTINGS)
    return changes.select("id", *PLUG, C.member_key().alias("member"), "ts_ms", "flag", "previous_flag")


def _outliers(plan, settings=SETTINGS, source=readings_from_events):
    def run(spark, d):
        result = plan(source(spark, d), settings)
        return result.select("id", "ts_ms", "time_frame", *PLUG, _r("percentage"))

    return run


def _house_flag_snapshot(spark, d):
    flags = O.flag_snapshot(O.plug_flags(readings_from_events(spark, d), SETTINGS))
    return flags.select(*PLUG, C.member_key().alias("member"), "flag", "ts_ms")


def _snapshot_percentage(spark, d):
    flags = O.flag_snapshot(O.plug_flags(readings_from_events(spark, d), SETTINGS))
    return O.snapshot_percentage(flags).select(*HOUSE, _r("percentage"), "plug_count")


def _outlier_grid(spark, d):
    result = O.grid_outliers(readings_from_events(spark, d), 6 * HOUR_MS, SETTINGS.with_window(DAY_MS))
    return result.select(*PLUG, "window_end", "flag", "above_count", "plug_count", _r("percentage"))


def _punctuated(spark, d):
    rows = A.with_markers(_plugs(spark, d))
    order = ["slice_idx", "is_marker", "household_id", "plug_id"]
    batches = A.punctuated_batches(rows, "is_marker", HOUSE, order, SETTINGS)
    weight = F.col("value_count")
    return batches.groupBy(*HOUSE, "batch_no").agg(
        _six(F.sum(F.col("average_load") * weight) / F.sum(weight)).alias("average_load"),
        F.sum("readings_count").alias("readings_count"),
    )


def _sample_every_n(spark, d):
    rows = P.running_average(_rows(spark, d), HOUSE, SETTINGS).select("id", "ts_ms", *HOUSE, "current_load")
    return sample_every_n(rows, 100, ["ts_ms", "id"], SETTINGS).select(
        "row_no", "id", *HOUSE, _r("current_load")
    )


def _time_labels(spark, d):
    rows = readings_from_events(spark, d)
    idx = C.slice_index(F.col("ts_ms"), SETTINGS)
    return rows.select(
        "id", C.slice_label(idx, SETTINGS).alias("time_slice"), C.time_frame(F.col("ts_ms"), HOUR_MS).alias("time_frame"),
        C.plug_key().alias("plug_key"),
    )


def _suffix_map(spark, d):
    words = spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", F.explode(F.split("text", " ")).alias("word")
    ).where("word <> ''")
    return words.select("doc_id", C.suffixed(F.col("word"), times=2).alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")
    )


def _round_half_up(spark, d):
    rows = readings_from_events(spark, d)
    return rows.select("id", C.round_half_up(F.col("value"), 1).alias("rounded"))


def _sql_steps(spark, d):
    steps = [
        "create or replace temp view plug_day as select house_id, household_id, plug_id, ts_ms div 86400000 as day_no, "
        "avg(value) as average_load, count(*) as n from readings where property = 1 "
        "group by house_id, household_id, plug_id, ts_ms div 86400000",
        "select house_id, day_no, cast(round(cast(sum(average_load * n) / sum(n) as decimal(38,9)), 6) as double) as average_load, sum(n) as n, "
        "count(*) as plugs from plug_day group by house_id, day_no",
    ]
    return run_statements(spark, {"readings": readings_from_events(spark, d)}, steps)


def _persisted(spark, d) -> str:
    folder = new_folder(spark, "archive")
    sinks.persist_readings(
        stream_readings_from_events(spark, d), folder, new_folder(spark, "state"), available_now=True
    ).awaitTermination()
    return folder


def _persist_roundtrip(spark, d):
    archive = read_archive(spark, _persisted(spark, d))
    return A.plug_slices(slice_rows(archive, SETTINGS), SETTINGS).select(
        *PLUG, "slice_idx", _r("average_load"), "readings_count"
    )


def _stream_predict(keys):
    def run(spark, d):
        folder = new_folder(spark, "prediction")
        S.prepare_history(readings_from_events(spark, d, end_ms=SETTINGS.live_start_ms), keys, SETTINGS, folder)
        S.stream_prediction(
            stream_readings_from_events(spark, d), keys, SETTINGS, folder, new_folder(spark, "state"), available_now=True
        ).awaitTermination()
        key = [C.plug_key().alias("plug_key")] if keys == PLUG else []
        return spark.read.parquet(f"{folder}/predictions").select(
            *keys, *key, "slice_idx", "time_slice", _r("current_load"), _r("predicted_load")
        )

    return run


def _stream_outliers(spark, d):
    folder = new_folder(spark, "outliers")
    S.stream_outliers(
        stream_readings_from_events(spark, d), 6 * HOUR_MS, SETTINGS.with_window(DAY_MS), folder,
        new_folder(spark, "state"), available_now=True,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/changes").select(
        *PLUG, "time_frame", "window_end", "flag", "above_count", "plug_count", _r("percentage")
    )


def _streamed_medians(spark, d, keys, settings=SETTINGS.with_window(HOUR_MS)) -> Tables:
    folder = new_folder(spark, "medians")
    K.stream_sliding_median(
        stream_readings_from_events(spark, d), keys, settings, folder, new_folder(spark, "state"), available_now=True
    ).awaitTermination()
    return Tables(spark, folder)


def _global_medians(spark, d) -> DataFrame:
    """The table of closed global medians as a stream."""
    return _streamed_medians(spark, d, []).follow("medians", K.GLOBAL_MEDIAN)


def _stream_global_median(spark, d):
    medians = _streamed_medians(spark, d, []).all("medians", K.GLOBAL_MEDIAN)
    return medians.select("ts_ms", _r("global_median"))


def _written(spark, rows: DataFrame) -> DataFrame:
    """The rows of a stream, written by the file sink."""
    folder = new_folder(spark, "rows")
    sinks.write_results(rows, folder, new_folder(spark, "state"), available_now=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(folder)


def _stream_plug_median(spark, d):
    medians = K.plug_medians(stream_readings_from_events(spark, d), SETTINGS.with_window(HOUR_MS))
    return _written(spark, medians).select(*PLUG, "ts_ms", _r("median").alias("plug_median"))


def _stream_reading_with_global_median(spark, d):
    rows = K.with_global_median(stream_readings_from_events(spark, d), _global_medians(spark, d), SETTINGS)
    return _written(spark, rows).select("id", *PLUG, "ts_ms", "value", _r("global_median"))


def _in_turns(spark, d):
    """The readings as a stream of the events table that begins anew at each call, and whether it comes in turns.

    A table of more than TURN_ROWS rows would be one micro-batch, whose state is the whole table. It is written in the
    order of its times, as a stream would have brought it, and a micro-batch takes about TURN_ROWS rows.
    """
    readings = readings_from_events(spark, d)
    turns = -(-readings.count() // TURN_ROWS)
    if turns > 1:
        folder = new_folder(spark, "turns")
        ranged = readings.repartitionByRange(turns, "ts_ms").sortWithinPartitions("ts_ms").withColumn("turn", F.spark_partition_id())
        if write_turns(ranged, "turn", folder):
            return lambda: with_event_time(follow_turns(spark, folder, readings.schema)), True
    return lambda: stream_readings_from_events(spark, d), False


def _stream_q2a_changes(spark, d):
    stream, in_turns = _in_turns(spark, d)
    settings = SETTINGS.with_window(HOUR_MS)
    tables, folder = Tables(spark, new_folder(spark, "medians")), new_folder(spark, "changes")
    K.stream_sliding_median(stream(), [], settings, tables.folder, new_folder(spark, "state"), available_now=True).awaitTermination()
    medians = tables.follow("medians", K.GLOBAL_MEDIAN)
    if in_turns:  # either side of the join waits for the other, so the medians of a turn come with its readings
        batches = [tables.read("medians", [b], K.GLOBAL_MEDIAN).withColumn("turn", F.lit(b)) for b in tables.batches("medians")]
        turns = new_folder(spark, "turns")
        ordered = write_turns(reduce(DataFrame.union, batches).repartition("turn").sortWithinPartitions("turn", "ts_ms"), "turn", turns)
        medians = follow_turns(spark, turns, K.GLOBAL_MEDIAN, ordered)
    K.stream_outlier_changes(stream(), medians, settings, folder, new_folder(spark, "state"), available_now=True).awaitTermination()
    return Tables(spark, folder).all("changes", K.CHANGES).select("id", "ts_ms", "time_frame", *PLUG, _r("percentage"))


def _stream_per_reading(keys):
    def run(spark, d):
        folder = new_folder(spark, "readings")
        K.prepare_partials(readings_from_events(spark, d, end_ms=SETTINGS.live_start_ms), keys, SETTINGS, folder)
        K.stream_predict_per_reading(
            stream_readings_from_events(spark, d), keys, SETTINGS, folder, new_folder(spark, "state"), available_now=True
        ).awaitTermination()
        key = [C.plug_key().alias("plug_key")] if keys == PLUG else []
        types = ", ".join(f"{k} int" for k in keys)
        rows = Tables(spark, folder).all("predictions", f"id bigint, {types}, slice_idx bigint, time_slice string, current_load double, predicted_load double")
        return rows.select("id", *keys, *key, "slice_idx", "time_slice", _r("current_load"), _r("predicted_load"))

    return run


def _sliding_sample(spark, d):
    rows = K.sample_medians(stream_readings_from_events(spark, d), HOUSE, 5, SAMPLE_SEED, SETTINGS.with_window(DAY_MS))
    return _written(spark, rows).select(*HOUSE, "ts_ms", _r("median"), "drawn")


def _kll_median_house(spark, d):
    """Stored sketches per slice, merged over all days, and whether the median is within 2 % of the middle rank."""
    loads = _load_readings(spark, d)
    medians = M.quantile_of_sketches(materialized(M.sketch_slices(loads, HOUSE, SETTINGS)), HOUSE)
    checked = M.with_rank_error(medians.drop("n"), loads, HOUSE)
    return checked.select(*HOUSE, "n", (F.col("rank_error") <= 0.02).alias("rank_ok"))


def _stream_last_n(spark, d):
    slices = S.slice_averages(stream_readings_from_events(spark, d), HOUSE, SETTINGS, start_ms=0)
    slices = A.with_day_and_slot(slices.withColumnRenamed("current_load", "average_load"), SETTINGS)
    folder = new_folder(spark, "slices")
    sinks.write_results(slices, folder, new_folder(spark, "state"), available_now=True).awaitTermination()
    lists = keyed.last_n_lists(spark.readStream.schema(slices.schema).parquet(folder), HOUSE, SETTINGS.history_days)
    latest = _written(spark, lists).groupBy(*HOUSE, "slot").agg(F.max_by(F.arrays_zip("days", "averages"), "newest").alias("held"))
    return latest.select(*HOUSE, "slot", F.posexplode("held").alias("at", "entry")).select(
        *HOUSE, "slot", F.col("entry.days").alias("day"), (F.col("at") + 1).alias("age"),
        _six(F.col("entry.averages")).alias("average_load"),
    )


def _stream_punctuated(spark, d):
    """The archive rows with their markers come in three parts in the order of their slices; the stream restarts for each."""
    rows = materialized(A.with_markers(_plugs(spark, d)).select(*HOUSE, "slice_idx", "average_load", "readings_count", "value_count", "is_marker"))
    first, last = rows.agg(F.min("slice_idx"), F.max("slice_idx")).first()
    source, folder, state = (new_folder(spark, name) for name in ("source", "batches", "state"))
    third = ((last or 0) - (first or 0)) // 3 + 1
    for k in range(3):
        low = (first or 0) + k * third
        rows.where(F.col("slice_idx").between(low, low + third - 1)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        batches = keyed.punctuated_averages(stream, "is_marker", "slice_idx", HOUSE)
        sinks.write_results(batches, folder, state, available_now=True).awaitTermination()
    return spark.read.parquet(folder).select(*HOUSE, "batch_no", _r("average_load"), "readings_count")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "load_readings": lambda spark, d: _load_readings(spark, d).select("id", "ts_ms", "value", "property", *PLUG),
        "archive_plug_slice": _archive_plug_slice,
        "archive_window_scan": _archive_window_scan,
        "archive_house_weighted_avg": _archive_house,
        "archive_last_n": _archive_last_n,
        "history_median_house": _history_median(HOUSE),
        "history_median_plug": _history_median(PLUG),
        "house_running_avg": _running_avg(HOUSE),
        "plug_running_avg": _running_avg(PLUG),
        "house_slice_avg": _slice_avg(HOUSE),
        "plug_slice_avg": _slice_avg(PLUG),
        "q1a_predict_house": _predict(HOUSE),
        "q1b_predict_plug": _predict(PLUG),
        "q1a_per_reading": _predict(HOUSE, per_reading=True),
        "q1b_per_reading": _predict(PLUG, per_reading=True),
        "global_median_1h": _global_median(HOUR_MS),
        "plug_median_1h": _plug_median(HOUR_MS),
        "global_median_24h": _global_median(DAY_MS),
        "plug_median_24h": _plug_median(DAY_MS),
        "global_median_grid_1h": _global_median_grid,
        "exact_median_house": _exact_median_house,
        "reservoir_median": _reservoir([], 1000),
        "reservoir_median_house": _reservoir(HOUSE, 50),
        "sketch_median_house": _sketch_median_house,
        "hist_lower_median": _hist_lower_median,
        "reading_with_global_median": _reading_with_global_median,
        "plug_flag_changes": _plug_flag_changes,
        "q2a_outliers_1h": _outliers(O.q2a),
        "q2b_outliers_24h": _outliers(O.q2b),
        "house_flag_snapshot": _house_flag_snapshot,
        "snapshot_percentage": _snapshot_percentage,
        "house_outlier_pct_grid": _outlier_grid,
        "punctuated_weighted_avg": _punctuated,
        "sample_every_n": _sample_every_n,
        "timeframe_labels": _time_labels,
        "suffix_map": _suffix_map,
        "round_half_up": _round_half_up,
        "sql_steps": _sql_steps,
        "persist_roundtrip": _persist_roundtrip,
        "stream_q1a": _stream_predict(HOUSE),
        "stream_q1b": _stream_predict(PLUG),
        "stream_q2a": _stream_outliers,
        "stream_global_median_1h": _stream_global_median,
        "stream_plug_median_1h": _stream_plug_median,
        "stream_reading_with_global_median": _stream_reading_with_global_median,
        "stream_q2a_changes": _stream_q2a_changes,
        "sliding_sample_median": _sliding_sample,
        "kll_median_house": _kll_median_house,
        "stream_archive_last_n": _stream_last_n,
        "stream_punctuated_avg": _stream_punctuated,
        "stream_q1a_per_reading": _stream_per_reading(HOUSE),
        "stream_q1b_per_reading": _stream_per_reading(PLUG),
        "house_limited_plug_slice": _house_limited,
        "q2a_blocks": _outliers(O.q2a, SMALL),
        "running_blocks": _running_avg(HOUSE, SMALL_WINDOWS),
        "sliding_dense": _global_median(DAY_MS, SMALL_DAYS),
        "q2a_with_nulls": _outliers(O.q2a, source=_holey),
        "house_running_avg_nulls": _running_avg(HOUSE, source=_holey),
        "running_blocks_nulls": _running_avg(HOUSE, SMALL_WINDOWS, _holey),
        **(_extra.QUERIES if _extra else {}),
        **({"pipeline": _pipeline.run} if _pipeline else {}),
    }


# DuckDB side. Written independently of the Spark plans: naive windows, explicit history joins.

_READINGS = """
readings AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, value,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS property,
         CAST(user_id // 45 AS INTEGER) AS plug_id, CAST((user_id // 15) % 3 AS INTEGER) AS household_id,
         CAST(user_id % 15 AS INTEGER) AS house_id
  FROM events),
loads AS (SELECT * FROM readings WHERE property = 1),
q1_rows AS (
  SELECT *, CAST(floor((ts_ms - 1705968000000) / 21600000) AS BIGINT) AS slice_idx FROM loads),
plug_slices AS (
  SELECT house_id, household_id, plug_id, slice_idx, avg(value) AS average_load, count(*) AS readings_count
  FROM q1_rows GROUP BY house_id, household_id, plug_id, slice_idx),
house_slices AS (
  SELECT house_id, slice_idx, avg(value) AS average_load, count(*) AS readings_count
  FROM q1_rows GROUP BY house_id, slice_idx)"""

_LABEL = """strftime(make_timestamp(((slice_idx + {ahead}) * 21600000 + 1705968000000) * 1000), '%H:%M') || ' TO ' ||
  strftime(make_timestamp(((slice_idx + {ahead}) * 21600000 + 1705968000000 + 21600000) * 1000), '%H:%M')"""

_FRAME = """strftime(make_timestamp((ts_ms - {width}) * 1000), '%d-%b-%Y %H:%M:%S') || ' TO ' ||
  strftime(make_timestamp(ts_ms * 1000), '%d-%b-%Y %H:%M:%S')"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_READINGS, *ctes]) + "\n" + body


def _history_cte(keys: str, table: str) -> str:
    same = " AND ".join(f"h.{k} = l.{k}" for k in keys.split(", "))
    cols = ", ".join(f"l.{k}" for k in keys.split(", "))
    return f"""history AS (
  SELECT {cols}, l.slice_idx, median(h.average_load) AS history_median, count(*) AS history_count
  FROM {table} l CROSS JOIN range(1, 30) AS k(n)
  JOIN {table} h ON {same} AND h.slice_idx = l.slice_idx + 2 - k.n * 4
  WHERE l.slice_idx >= 0 GROUP BY {cols}, l.slice_idx)"""


def _running_cte(keys: str) -> str:
    over = f"OVER (PARTITION BY {keys}, slice_idx ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING)"
    return f"live AS (SELECT *, sum(value) {over} / nullif(count(value) {over}, 0) AS current_load, count(*) {over} AS n FROM q1_rows)"


def _flags_cte(width: int) -> str:
    frame = f"ORDER BY ts_ms RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW"
    return f"""medians AS (
  SELECT *, median(value) OVER ({frame}) AS global_median,
         median(value) OVER (PARTITION BY house_id, household_id, plug_id {frame}) AS plug_median FROM loads),
flags AS (SELECT *, plug_median > global_median AS flag FROM medians WHERE plug_median IS NOT NULL AND global_median IS NOT NULL),
lagged AS (
  SELECT *, lag(flag) OVER (PARTITION BY house_id, household_id, plug_id ORDER BY ts_ms, id) AS previous_flag FROM flags),
changes AS (SELECT * FROM lagged WHERE previous_flag IS NULL OR previous_flag <> flag)"""


_MOVES = """CASE WHEN previous_flag IS NULL THEN CAST(flag AS INTEGER) WHEN flag THEN 1 ELSE -1 END"""

_GRID = """windows AS (
  SELECT house_id, household_id, plug_id, value, (ts_ms // 21600000 + k.n) * 21600000 AS window_end
  FROM loads CROSS JOIN range(1, 5) AS k(n)),
overall AS (SELECT window_end, median(value) AS global_median FROM windows GROUP BY window_end),
plugs AS (
  SELECT house_id, household_id, plug_id, window_end, median(value) AS plug_median
  FROM windows GROUP BY house_id, household_id, plug_id, window_end),
flags AS (SELECT plugs.*, plug_median > global_median AS flag FROM plugs JOIN overall USING (window_end) {where}),
lagged AS (
  SELECT *, lag(flag) OVER (PARTITION BY house_id, household_id, plug_id ORDER BY window_end) AS previous_flag FROM flags),
changes AS (SELECT * FROM lagged WHERE previous_flag IS NULL OR previous_flag <> flag),
totals AS (
  SELECT *, sum({moves}) OVER w AS above_count, count(*) FILTER (previous_flag IS NULL) OVER w AS plug_count
  FROM changes WINDOW w AS (PARTITION BY house_id ORDER BY window_end, household_id, plug_id ROWS UNBOUNDED PRECEDING))"""

_GRID_RESULT = """SELECT house_id, household_id, plug_id, {frame} window_end, flag, CAST(above_count AS BIGINT) AS above_count,
  CAST(plug_count AS BIGINT) AS plug_count, CAST(round(CAST(above_count * 100.0 / plug_count AS DECIMAL(38,9)), 6) AS DOUBLE) AS percentage FROM totals"""

_CLOSED = "(SELECT max(ts_ms) - 60000 FROM {rows})"
_PLUG_COLS = "house_id, household_id, plug_id"


def _predict_sql(keys: str, closed: bool = False) -> str:
    table = "plug_slices" if "plug_id" in keys else "house_slices"
    key = "house_id || '_' || household_id || '_' || plug_id AS plug_key," if "plug_id" in keys else ""
    ended = (
        "WHERE (slice_idx + 1) * 21600000 + 1705968000000 <= " + _CLOSED.format(rows="readings") if closed else ""
    )
    return _sql(
        f"SELECT {keys}, {key} slice_idx, {_LABEL.format(ahead=2)} AS time_slice, CAST(round(CAST(average_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS current_load, "
        f"CAST(round(CAST((history_median + average_load) / 2 AS DECIMAL(38,9)), 6) AS DOUBLE) AS predicted_load "
        f"FROM {table} JOIN history USING ({keys}, slice_idx) {ended}",
        _history_cte(keys, table),
    )


def _per_reading_sql(keys: str, closed: bool = False) -> str:
    table = "plug_slices" if "plug_id" in keys else "house_slices"
    key = "house_id || '_' || household_id || '_' || plug_id AS plug_key," if "plug_id" in keys else ""
    return _sql(
        f"SELECT id, {keys}, {key} slice_idx, {_LABEL.format(ahead=2)} AS time_slice, "
        f"CAST(round(CAST(current_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS current_load, CAST(round(CAST((history_median + current_load) / 2 AS DECIMAL(38,9)), 6) AS DOUBLE) AS predicted_load "
        f"FROM live JOIN history USING ({keys}, slice_idx)" + (f" WHERE ts_ms <= {_CLOSED.format(rows='readings')}" if closed else ""),
        _history_cte(keys, table), _running_cte(keys),
    )


def _outliers_sql(width: int) -> str:
    over = "OVER (PARTITION BY house_id ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING)"
    return _sql(
        f"SELECT id, ts_ms, {_FRAME.format(width=width)} AS time_frame, {_PLUG_COLS}, "
        f"CAST(round(CAST(100.0 * sum({_MOVES}) {over} / count(*) FILTER (previous_flag IS NULL) {over} AS DECIMAL(38,9)), 6) AS DOUBLE) AS percentage FROM changes",
        _flags_cte(width),
    )


def _of_closed(sql: str) -> str:
    """The rows of a query over readings whose time a stream has closed at the end of the table."""
    return f"SELECT closed.* FROM ({sql}) closed WHERE ts_ms <= (SELECT max(epoch_us(ts) // 1000) - 60000 FROM events)"


def _holes(sql: str) -> str:
    missing = "CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value,"
    return sql.replace("AS ts_ms, value,", f"AS ts_ms, {missing}")


def _history_sql(keys: str) -> str:
    return _sql(
        f"SELECT {keys}, slice_idx + 2 AS target_slice, CAST(round(CAST(history_median AS DECIMAL(38,9)), 6) AS DOUBLE) AS history_median, history_count FROM history",
        _history_cte(keys, "plug_slices" if "plug_id" in keys else "house_slices"),
    )


def _running_sql(keys: str) -> str:
    return _sql(
        f"SELECT id, {keys}, slice_idx, CAST(round(CAST(current_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS current_load, n AS readings_count FROM live",
        _running_cte(keys),
    )


def _slice_sql(keys: str) -> str:
    return _sql(
        f"SELECT {keys}, slice_idx, CAST(round(CAST(avg(value) AS DECIMAL(38,9)), 6) AS DOUBLE) AS current_load, count(*) AS readings_count "
        f"FROM q1_rows GROUP BY {keys}, slice_idx"
    )


def _global_sql(width: int) -> str:
    return _sql(
        "SELECT DISTINCT ts_ms, CAST(round(CAST(median(value) OVER (ORDER BY ts_ms RANGE BETWEEN "
        f"{width - 1} PRECEDING AND CURRENT ROW) AS DECIMAL(38,9)), 6) AS DOUBLE) AS global_median FROM loads"
    )


def _plug_sql(width: int) -> str:
    return _sql(
        f"SELECT DISTINCT {_PLUG_COLS}, ts_ms, CAST(round(CAST(median(value) OVER (PARTITION BY {_PLUG_COLS} ORDER BY ts_ms "
        f"RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS DECIMAL(38,9)), 6) AS DOUBLE) AS plug_median FROM loads"
    )


def _reservoir_sql(keys: str, k: int) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return _sql(
        f"SELECT {head}CAST(round(CAST(median(value) AS DECIMAL(38,9)), 6) AS DOUBLE) AS median, count(*) AS n FROM drawn WHERE rn <= {k}{group}",
        f"drawn AS (SELECT *, row_number() OVER ({part}ORDER BY md5('{SAMPLE_SEED}:' || id), id) AS rn FROM loads)",
    )


_SNAPSHOT = f"""latest AS (
  SELECT {_PLUG_COLS}, arg_max(flag, ts_ms) AS flag, max(ts_ms) AS ts_ms FROM flags GROUP BY {_PLUG_COLS})"""


def oracle_sql() -> dict[str, str]:
    plug_slice = _sql(
        f"SELECT {_PLUG_COLS}, slice_idx, CAST(round(CAST(average_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS average_load, readings_count FROM plug_slices"
    )
    last_n = _sql(
        "SELECT house_id, CAST(slot AS INTEGER) AS slot, CAST(day AS INTEGER) AS day, CAST(age AS INTEGER) AS age, "
        "CAST(round(CAST(average_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS average_load FROM aged WHERE age <= 29",
        "days AS (SELECT *, CAST(floor(slice_idx / 4) AS BIGINT) AS day, "
        "slice_idx - 4 * CAST(floor(slice_idx / 4) AS BIGINT) AS slot FROM house_slices {where})",
        "aged AS (SELECT *, row_number() OVER (PARTITION BY house_id, slot ORDER BY day DESC) AS age FROM days)",
    )
    punctuated = _sql(
        "SELECT house_id, row_number() OVER (PARTITION BY house_id ORDER BY slice_idx) AS batch_no, "
        "CAST(round(CAST(average_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS average_load, CAST(readings_count AS BIGINT) AS readings_count FROM house_slices"
    )
    return {
        "load_readings": _sql(f"SELECT id, ts_ms, value, property, {_PLUG_COLS} FROM loads"),
        "archive_plug_slice": plug_slice,
        "archive_window_scan": _sql(
            f"SELECT {_PLUG_COLS}, CAST(round(CAST(average_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS average_load, readings_count, k.n AS day_count, "
            f"{_LABEL.format(ahead=0)} AS time_slice FROM plug_slices JOIN range(1, 30) AS k(n) ON slice_idx = 2 - 4 * k.n"
        ),
        "archive_house_weighted_avg": _sql(
            "SELECT house_id, slice_idx, CAST(round(CAST(average_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS average_load, readings_count FROM house_slices"
        ),
        "archive_last_n": last_n.format(where=""),
        "history_median_house": _history_sql("house_id"),
        "history_median_plug": _history_sql(_PLUG_COLS),
        "house_running_avg": _running_sql("house_id"),
        "plug_running_avg": _running_sql(_PLUG_COLS),
        "house_slice_avg": _slice_sql("house_id"),
        "plug_slice_avg": _slice_sql(_PLUG_COLS),
        "q1a_predict_house": _predict_sql("house_id"),
        "q1b_predict_plug": _predict_sql(_PLUG_COLS),
        "q1a_per_reading": _per_reading_sql("house_id"),
        "q1b_per_reading": _per_reading_sql(_PLUG_COLS),
        "global_median_1h": _global_sql(HOUR_MS),
        "plug_median_1h": _plug_sql(HOUR_MS),
        "global_median_24h": _global_sql(DAY_MS),
        "plug_median_24h": _plug_sql(DAY_MS),
        "global_median_grid_1h": _sql(
            "SELECT (ts_ms // 900000 + k.n) * 900000 AS window_end, CAST(round(CAST(median(value) AS DECIMAL(38,9)), 6) AS DOUBLE) AS median, count(*) AS n "
            "FROM loads CROSS JOIN range(1, 5) AS k(n) GROUP BY (ts_ms // 900000 + k.n) * 900000"
        ),
        "exact_median_house": _sql(
            "SELECT house_id, CAST(round(CAST(median(value) AS DECIMAL(38,9)), 6) AS DOUBLE) AS median, count(*) AS n FROM loads GROUP BY house_id"
        ),
        "reservoir_median": _reservoir_sql("", 1000),
        "reservoir_median_house": _reservoir_sql("house_id", 50),
        # Up to 10,000 readings per house the rank error of the sketch is below one row.
        "sketch_median_house": _sql(
            "SELECT house_id, quantile_disc(value, 0.5) AS median, count(*) AS n FROM loads GROUP BY house_id"
        ),
        "hist_lower_median": _sql(
            "SELECT house_id, quantile_disc(value, 0.5) AS median, count(*) AS n FROM loads GROUP BY house_id"
        ),
        "reading_with_global_median": _sql(
            f"SELECT id, {_PLUG_COLS}, ts_ms, value, CAST(round(CAST(global_median AS DECIMAL(38,9)), 6) AS DOUBLE) AS global_median FROM medians",
            _flags_cte(HOUR_MS),
        ),
        "plug_flag_changes": _sql(
            f"SELECT id, {_PLUG_COLS}, household_id || '-' || plug_id AS member, ts_ms, flag, previous_flag FROM changes",
            _flags_cte(HOUR_MS),
        ),
        "q2a_outliers_1h": _outliers_sql(HOUR_MS),
        "q2b_outliers_24h": _outliers_sql(DAY_MS),
        "house_flag_snapshot": _sql(
            f"SELECT {_PLUG_COLS}, household_id || '-' || plug_id AS member, flag, ts_ms FROM latest",
            _flags_cte(HOUR_MS), _SNAPSHOT,
        ),
        "snapshot_percentage": _sql(
            "SELECT house_id, CAST(round(CAST(avg(CASE WHEN flag THEN 100.0 ELSE 0.0 END) AS DECIMAL(38,9)), 6) AS DOUBLE) AS percentage, count(*) AS plug_count "
            "FROM latest GROUP BY house_id",
            _flags_cte(HOUR_MS), _SNAPSHOT,
        ),
        "house_outlier_pct_grid": _sql(_GRID_RESULT.format(frame=""), _GRID.format(where="", moves=_MOVES)),
        "punctuated_weighted_avg": punctuated,
        "stream_punctuated_avg": punctuated,
        "stream_archive_last_n": last_n.format(where=f"WHERE (slice_idx + 1) * 21600000 + 1705968000000 <= {_CLOSED.format(rows='readings')}"),
        "kll_median_house": _sql("SELECT house_id, count(*) AS n, true AS rank_ok FROM loads GROUP BY house_id"),
        "sliding_sample_median": _of_closed(_sql(
            "SELECT house_id, ts_ms, CAST(round(CAST(median(value) AS DECIMAL(38,9)), 6) AS DOUBLE) AS median, count(*) AS drawn "
            "FROM ranked WHERE rn <= 5 GROUP BY house_id, ts_ms",
            "ranked AS (SELECT a.house_id, a.ts_ms, b.value, row_number() OVER (PARTITION BY a.house_id, a.ts_ms "
            f"ORDER BY substr(md5('{SAMPLE_SEED}:' || b.id), 1, 13), b.id) AS rn "
            "FROM (SELECT DISTINCT house_id, ts_ms FROM loads) a JOIN loads b ON a.house_id = b.house_id "
            f"AND b.ts_ms <= a.ts_ms AND b.ts_ms > a.ts_ms - {DAY_MS})",
        )),
        "sample_every_n": _sql(
            "SELECT row_no, id, house_id, CAST(round(CAST(current_load AS DECIMAL(38,9)), 6) AS DOUBLE) AS current_load "
            "FROM (SELECT *, row_number() OVER (ORDER BY ts_ms, id) AS row_no FROM live) WHERE row_no % 100 = 0",
            _running_cte("house_id"),
        ),
        "timeframe_labels": _sql(
            f"SELECT id, {_LABEL.format(ahead=0)} AS time_slice, {_FRAME.format(width=HOUR_MS)} AS time_frame, "
            "house_id || '_' || household_id || '_' || plug_id AS plug_key FROM (SELECT *, "
            "CAST(floor((ts_ms - 1705968000000) / 21600000) AS BIGINT) AS slice_idx FROM readings)"
        ),
        "suffix_map": "SELECT w || '!!!!!!' AS word, count(*) AS n, count(DISTINCT doc_id) AS docs "
        "FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w",
        "round_half_up": _sql(
            "SELECT id, CAST(round(CAST(CAST(value AS VARCHAR) AS DECIMAL(38,18)), 1) AS DOUBLE) AS rounded FROM readings"
        ),
        "sql_steps": _sql(
            "SELECT house_id, ts_ms // 86400000 AS day_no, CAST(round(CAST(avg(value) AS DECIMAL(38,9)), 6) AS DOUBLE) AS average_load, count(*) AS n, "
            f"count(DISTINCT (household_id, plug_id)) AS plugs FROM loads GROUP BY house_id, ts_ms // 86400000"
        ),
        "persist_roundtrip": plug_slice,
        "stream_q1a": _predict_sql("house_id", closed=True),
        "stream_q1b": _predict_sql(_PLUG_COLS, closed=True),
        "stream_q2a": _sql(
            _GRID_RESULT.format(frame=_FRAME.format(width=DAY_MS).replace("ts_ms", "window_end") + " AS time_frame,"),
            _GRID.format(where="WHERE window_end <= " + _CLOSED.format(rows="readings"), moves=_MOVES),
        ),
        "stream_global_median_1h": _of_closed(_global_sql(HOUR_MS)),
        "stream_plug_median_1h": _of_closed(_plug_sql(HOUR_MS)),
        "stream_reading_with_global_median": _of_closed(_sql(
            f"SELECT id, {_PLUG_COLS}, ts_ms, value, CAST(round(CAST(global_median AS DECIMAL(38,9)), 6) AS DOUBLE) AS global_median FROM medians",
            _flags_cte(HOUR_MS),
        )),
        "stream_q2a_changes": _of_closed(_outliers_sql(HOUR_MS)),
        "stream_q1a_per_reading": _per_reading_sql("house_id", closed=True),
        "stream_q1b_per_reading": _per_reading_sql(_PLUG_COLS, closed=True),
        "house_limited_plug_slice": plug_slice.replace("FROM loads),", "FROM loads WHERE house_id < 10),"),
        "q2a_blocks": _outliers_sql(HOUR_MS),
        "running_blocks": _running_sql("house_id"),
        "sliding_dense": _global_sql(DAY_MS),
        "q2a_with_nulls": _holes(_outliers_sql(HOUR_MS)),
        "house_running_avg_nulls": _holes(_running_sql("house_id")),
        "running_blocks_nulls": _holes(_running_sql("house_id")),
        **(_extra.ORACLE_SQL if _extra else {}),
        **({"pipeline": _pipeline.ORACLE_SQL} if _pipeline and _pipeline.ORACLE_SQL else {}),
    }
