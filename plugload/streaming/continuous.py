"""Streaming forms that answer every reading, in event order behind the watermark.

A reading is closed once the watermark (largest event time of any reading minus ``watermark_ms``) has reached it; later
readings of that time are dropped. Every micro-batch closes a range of time of its own, after those closed before,
and all results are those of the batch plans over the closed readings.
"""

from __future__ import annotations

from collections.abc import Sequence
from time import time

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from plugload.functions.columns import day_of, predicted, slice_index, slice_label, time_frame
from plugload.operators.archive import history_median
from plugload.operators.blocks import running
from plugload.operators.sliding import sliding_median
from plugload.plans.outliers import count_moves
from plugload.schema import HOUSE, PLUG
from plugload.settings import LOAD, Settings
from plugload.sources.readings import between, slice_rows
from plugload.streaming.keyed import FlagChanges, SlidingMedian, SlidingSample, in_event_order
from plugload.streaming.tables import Tables, deliver

GLOBAL_MEDIAN = "ts_ms bigint, global_median double"
CHANGES = (
    "house_id int, household_id int, plug_id int, ts_ms bigint, id bigint, flag boolean, previous_flag boolean, "
    "above_count bigint, plug_count bigint, percentage double, time_frame string, eval_ms bigint, latency_ms bigint"
)


def _interval(ms: int) -> str:
    return f"{ms} milliseconds"


def _trigger(available_now: bool, every: str) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": every}


def _wanted(s: Settings, limited: bool = False) -> Column:
    wanted = F.col("property") == LOAD
    return wanted & (F.col("house_id") < s.house_limit) if limited and s.house_limit is not None else wanted


def loads(stream: DataFrame, s: Settings, limited: bool = False) -> DataFrame:
    """Load readings of a stream, where every reading moves the watermark.

    Spark would move a plain filter below the watermark, which would then not see the other readings. It leaves a
    comparison with a random number where it is; 1 is above any such number, 0 above none.
    """
    marked = stream.withWatermark("ts", _interval(s.watermark_ms)).where(_wanted(s, limited).cast("int") > F.rand(0))
    return marked.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def closed_readings(stream: DataFrame, s: Settings, limited: bool = False) -> DataFrame:
    """Each load reading once it is closed: id, ts_ms, value, house, household, plug.

    An aggregation by the whole reading, so waiting readings spread over all tasks whatever their plug, and only those
    behind the watermark are in state. Readings that do not count are one group per time and dropped. Equal readings are
    counted and given back as often.
    """
    wanted = _wanted(s, limited)
    columns = {"value": F.when(~F.isnan("value"), F.col("value")), **{c: F.col(c) for c in ("id", *PLUG)}}
    grouped = stream.withWatermark("ts", _interval(s.watermark_ms)).groupBy(
        "ts", *(F.when(wanted, c).alias(name) for name, c in columns.items())
    ).agg(F.count(F.when(wanted, 1)).alias("copies")).where("copies > 0")
    return grouped.select(
        "id", F.unix_millis("ts").alias("ts_ms"), "value", *PLUG, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")
    ).drop("_copy")


def _start(rows: DataFrame, write, state: str, available_now: bool, every: str) -> StreamingQuery:
    return (
        rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", state)
        .trigger(**_trigger(available_now, every)).start()
    )


# -- sliding medians ----------------------------------------------------------------------------------------------------


def stream_sliding_median(
    stream: DataFrame, keys: Sequence[str], s: Settings, folder: str, state: str,
    available_now: bool = False, every: str = "1 minute",
) -> StreamingQuery:
    """Median of (t - width, t] at each closed time, per key or over all readings, as the table ``medians``.

    For groups of any size: a batch is answered by ``sliding_median`` over its readings and those of the width
    before it, which are kept as tables and removed when no later window reaches them.
    """
    tables = Tables(stream.sparkSession, folder)
    kept_schema = "batch bigint, newest bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = tables.publish("readings", batch_id, batch.select(*keys, "ts_ms", "value", "id"))
        first, newest = fresh.agg(F.min("ts_ms"), F.max("ts_ms")).first()
        kept = {r["batch"]: r["newest"] for r in tables.read("kept", [batch_id - 1], kept_schema).collect()}
        rows = fresh
        if newest is not None:
            tail = tables.read("readings", [b for b, end in kept.items() if end > first - s.window_ms], fresh.schema)
            rows = tail.where(F.col("ts_ms") > first - s.window_ms).unionByName(fresh)
            kept = {b: end for b, end in {**kept, batch_id: newest}.items() if end > newest - s.window_ms}
        found = sliding_median(rows, keys, s.window_ms, s, since=first or 0)
        name = "median" if keys else "global_median"
        ids = ["first_id"] if keys else []
        tables.publish("medians", batch_id, found.select(*keys, "ts_ms", *ids, F.col("median").alias(name)))
        remembered = stream.sparkSession.createDataFrame(list(kept.items()), kept_schema).coalesce(1)
        tables.publish("kept", batch_id, remembered)
        # The batch before may still be retried by its reader only; what is older than it can go.
        before = {r["batch"] for r in tables.read("kept", [batch_id - 1], kept_schema).collect()}
        tables.drop("readings", [b for b in tables.batches("readings") if b < batch_id and b not in kept and b not in before])
        tables.drop("kept", [b for b in tables.batches("kept") if b < batch_id - 1])

    return _start(closed_readings(stream, s), write, state, available_now, every)


def plug_medians(stream: DataFrame, s: Settings, idle_ms: int | None = None) -> DataFrame:
    """Streaming median of each plug at each of its closed times, from keyed state: plug, ts_ms, id, median.

    State holds the readings of one width per plug, in time order and by rank; a reading costs a few steps in both.
    """
    return in_event_order(loads(stream, s), PLUG, SlidingMedian(s.window_ms), idle_ms)


def sample_draw(seed: int, id_col: str = "id") -> Column:
    """52 random bits of a reading, as a double; the same for the same seed and id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col))), 1, 13)
    return F.conv(digits, 16, 10).cast("double")


def sample_medians(stream: DataFrame, keys: Sequence[str], k: int, seed: int, s: Settings, idle_ms: int | None = None) -> DataFrame:
    """Streaming median of k sampled readings of each key's window at its closed times: keys, ts_ms, id, median, drawn."""
    rows = loads(stream, s).withColumn("draw", sample_draw(seed))
    return in_event_order(rows, keys, SlidingSample(s.window_ms, k), idle_ms)


# -- readings with the global median, flags ---------------------------------------------------------------------------


def with_global_median(stream: DataFrame, medians: DataFrame, s: Settings) -> DataFrame:
    """Every load reading with the global median at its time: a join of two streams on event time.

    ``medians`` is the followed table of ``stream_sliding_median`` without keys, whose times only grow. Either side
    waits for the other; what the smaller of both watermarks has passed leaves the state.
    """
    right = medians.select(F.timestamp_millis("ts_ms").alias("median_ts"), "global_median").withWatermark("median_ts", "0 seconds")
    joined = loads(stream, s).join(right, F.col("ts") == F.col("median_ts"))
    return joined.select("id", *PLUG, "ts", "ts_ms", "value", "global_median")


def flag_changes(stream: DataFrame, medians: DataFrame, s: Settings, idle_ms: int | None = None) -> DataFrame:
    """Streaming changes of the flag of each plug, per reading: plug, ts_ms, id, flag, previous_flag."""
    return in_event_order(with_global_median(stream, medians, s), PLUG, FlagChanges(s.window_ms), idle_ms)


def stream_outlier_changes(
    stream: DataFrame, medians: DataFrame, s: Settings, folder: str, state: str,
    available_now: bool = False, every: str = "1 minute", log_every: int | None = None,
) -> StreamingQuery:
    """Percentage of flagged plugs per house after every change, in the order (ts_ms, id), as the table ``changes``.

    Flags are keyed state per plug. Changes of a batch come after those of all batches before, so a house is carried on
    by two totals, kept as a small table with a version per batch; within a batch ``running`` cuts large houses into
    blocks. So no task holds a house. Tables ``delivered`` and ``log`` have counts, latencies and every n-th row.
    """
    tables = Tables(stream.sparkSession, folder)
    totals_schema = "house_id int, known_above bigint, known_plugs bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        moved = tables.publish("moves", batch_id, batch)
        known = tables.read("totals", [batch_id - 1], totals_schema)
        rows = moved.count()  # from the Parquet footers; it bounds every group
        moves = count_moves()
        added = moved.groupBy(*HOUSE).agg(*(F.sum(c).alias(n) for c, n in zip(moves.values(), ("known_above", "known_plugs"))))
        both = known.unionByName(added).groupBy(*HOUSE).agg(*(F.sum(c).alias(c) for c in ("known_above", "known_plugs")))
        tables.publish("totals", batch_id, both.coalesce(1))
        counted = running(moved, HOUSE, ["ts_ms", "id"], s, sums=moves, largest=rows if rows <= s.window_rows else None)
        counted = counted.join(known, HOUSE, "left").na.fill(0, ["known_above", "known_plugs"])
        above, plugs = F.col("above_count") + F.col("known_above"), F.col("plug_count") + F.col("known_plugs")
        result = counted.select(
            *PLUG, "ts_ms", "id", "flag", "previous_flag", above.alias("above_count"), plugs.alias("plug_count"),
            (above * 100.0 / plugs).alias("percentage"), time_frame(F.col("ts_ms"), s.window_ms).alias("time_frame"),
            F.lit(round(time() * 1000)).alias("eval_ms"),
        )
        deliver(tables, batch_id, result, F.col("eval_ms"), ["ts_ms", "id"], s, log_every, "changes")
        for table in ("moves", "totals"):
            tables.drop(table, [b for b in tables.batches(table) if b < batch_id - 1])

    return _start(flag_changes(stream, medians, s), write, state, available_now, every)


# -- prediction per reading ---------------------------------------------------------------------------------------------


def _partials(rows: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """Sum, values and readings per key and slice; partial results of several batches add up."""
    return rows.groupBy(*keys, slice_index(F.col("ts_ms"), s).alias("slice_idx")).agg(
        F.sum("value").alias("total"), F.count("value").alias("values"), F.count("*").alias("readings_count")
    ).withColumn("day", day_of(F.col("slice_idx"), s))


def _added(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    return partials.groupBy(*keys, "slice_idx").agg(*(F.sum(c).alias(c) for c in ("total", "values", "readings_count")))


def prepare_partials(archive: DataFrame, keys: Sequence[str], s: Settings, folder: str) -> None:
    """Write the slice sums of ``start_days`` days before live_start, the starting history of ``stream_predict_per_reading``."""
    first = s.live_start_ms + (s.lookahead_slices - s.start_days * s.slices_per_day) * s.slice_ms
    rows = _partials(slice_rows(between(archive, first, s.live_start_ms), s), keys, s)
    Tables(archive.sparkSession, folder).publish("sums", -1, rows.repartitionByRange("day", "slice_idx"))


def stream_predict_per_reading(
    stream: DataFrame, keys: Sequence[str], s: Settings, folder: str, state: str,
    available_now: bool = False, every: str = "1 minute", log_every: int | None = None,
) -> StreamingQuery:
    """Average of the slice up to each closed live reading and the prediction from it, as the table ``predictions``.

    The table ``sums`` has the sums of every batch per key and slice. Sums add up, so those of earlier batches are
    where a running average goes on, and those of earlier days are the history. Within a batch ``running`` cuts large
    groups into blocks. Batches are merged into one once a day and days beyond the history left out, so the table stays bounded.
    """
    spark = stream.sparkSession
    tables = Tables(spark, folder)
    types = ", ".join(f"{k} int" for k in keys)
    schema = f"{types}, slice_idx bigint, total double, values bigint, readings_count bigint, day int"
    kept_schema = "batch bigint, day int"

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = tables.publish("readings", batch_id, batch.where(F.col("ts_ms") >= s.live_start_ms).select(*keys, "id", "ts_ms", "value"))
        own = tables.publish("sums", batch_id, _partials(fresh, keys, s))
        lowest, highest = own.agg(F.min("slice_idx"), F.max("slice_idx")).first()
        kept = [r["batch"] for r in tables.read("kept", [batch_id - 1], kept_schema).collect()] if batch_id else [-1]
        merged_day = max((r["day"] for r in tables.read("kept", [batch_id - 1], kept_schema).collect()), default=-1)
        if lowest is None:
            lowest = highest = 0
        earlier = tables.read("sums", kept, schema)
        carried = _added(earlier.where(F.col("slice_idx").between(lowest, highest)), keys)
        carried = carried.select(*keys, "slice_idx", *(F.col(c).alias(f"_{c}") for c in ("total", "values", "readings_count")))

        one = F.lit(1).cast("long")
        sums = {"sum": F.col("value"), "values": F.when(F.col("value").isNotNull(), one), "readings_count": one}
        rows = fresh.withColumn("slice_idx", slice_index(F.col("ts_ms"), s))
        most = own.agg(F.max("readings_count")).first()[0] or 0
        live = running(rows, [*keys, "slice_idx"], ["ts_ms", "id"], s, sums=sums, largest=most)
        live = live.join(carried, [*keys, "slice_idx"], "left")
        plus = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
        some = plus("values", "_values")
        current = F.when(some > 0, plus("sum", "_total") / some)
        live = live.select(*keys, "slice_idx", "id", "ts_ms", current.alias("current_load"), plus("readings_count", "_readings_count").alias("readings_count"))

        days = F.floor(F.lit(lowest) / s.slices_per_day).cast("int") - s.history_days
        known = _added(earlier.unionByName(own).where(F.col("day") >= days), keys)
        known = known.select(*keys, "slice_idx", F.when(F.col("values") > 0, F.col("total") / F.col("values")).alias("average_load"))
        asked = own.select(*keys, "slice_idx").distinct()
        medians = history_median(known, asked, keys, s).select(*keys, "slice_idx", "target_slice", "history_median")
        result = live.join(medians, [*keys, "slice_idx"]).select(
            "id", *keys, "ts_ms", "slice_idx", slice_label(F.col("target_slice"), s).alias("time_slice"), "current_load", "readings_count",
            predicted(F.col("history_median"), F.col("current_load")).alias("predicted_load"), F.lit(round(time() * 1000)).alias("eval_ms"),
        )
        deliver(tables, batch_id, result, F.col("eval_ms"), ["ts_ms", "id"], s, log_every, "predictions")
        _keep_sums(tables, keys, s, batch_id, kept, merged_day, highest, schema, kept_schema)

    return _start(closed_readings(stream, s, limited=True), write, state, available_now, every)


def _keep_sums(tables, keys, s, batch_id, kept, merged_day, highest, schema, kept_schema) -> None:
    """Note which batches hold the sums; when a day has begun, merge them and leave out days beyond the history."""
    day = highest // s.slices_per_day
    now = [*kept, batch_id]
    if day > merged_day and len(now) > 1:
        every = tables.read("sums", now, schema).where(F.col("day") >= day - s.history_days)
        merged = _added(every, keys).withColumn("day", day_of(F.col("slice_idx"), s)).select(*every.columns)
        # Numbers below -1 are merged batches: that of batch k is -2 - k.
        tables.publish("sums", -2 - batch_id, merged.repartitionByRange("day", "slice_idx"))
        now = [-2 - batch_id]
    rows = [(b, max(day, merged_day)) for b in now]
    tables.publish("kept", batch_id, tables.spark.createDataFrame(rows, kept_schema).coalesce(1))
    tables.drop("sums", [b for b in tables.batches("sums") if b not in now and b not in kept and b != batch_id])
    for table in ("readings", "kept"):
        tables.drop(table, [b for b in tables.batches(table) if b < batch_id - 1])
