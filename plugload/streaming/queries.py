"""Streaming forms of the queries: results appear per closed slice or window, not per reading.

A slice or window closes when the watermark (largest event time minus ``watermark_ms``) reaches its end. Later
readings of a closed window are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from time import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plugload.functions.columns import day_of, predicted, slice_index, slice_label, time_frame
from plugload.operators.archive import history_median
from plugload.plans.outliers import Sizes, count_moves, flag_changes, grid_flags
from plugload.plans.predict import key_averages
from plugload.operators.blocks import running
from plugload.schema import HOUSE, PLUG
from plugload.session import is_folder, remove, subfolders
from plugload.settings import LOAD, Settings
from plugload.sources.readings import between, slice_rows
from plugload.streaming.panes import left_of, needed, new_nodes, top_level, windows_of_nodes

PREDICTION = (
    "slice_idx bigint, current_load double, readings_count bigint, history_median double, history_count bigint, "
    "target_slice bigint, predicted_load double, time_slice string, eval_ms bigint"
)
FLAGS = "house_id int, household_id int, plug_id int, flag boolean"
CHANGES = (
    "house_id int, household_id int, plug_id int, window_end bigint, flag boolean, "
    "above_count bigint, plug_count bigint, percentage double, time_frame string, eval_ms bigint"
)


def _interval(ms: int) -> str:
    return f"{ms} milliseconds"


def _trigger(available_now: bool, every: str) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": every}


def _load(s: Settings, limited: bool) -> Column:
    wanted = F.col("property") == LOAD
    return wanted & (F.col("house_id") < s.house_limit) if limited and s.house_limit is not None else wanted


def slice_averages(stream: DataFrame, keys: Sequence[str], s: Settings, start_ms: int | None = None) -> DataFrame:
    """Streaming average and count per key and closed slice, from ``start_ms`` (live_start unless given) on.

    Any reading moves the watermark, also one that does not count here; so the readings that do not are not filtered
    out before but gathered under null keys, as groups without a counted reading, which are dropped at the end.
    """
    slices = F.window("ts", _interval(s.slice_ms), startTime=_interval(s.live_start_ms % s.slice_ms))
    wanted = _load(s, limited=True) & (F.col("ts_ms") >= (s.live_start_ms if start_ms is None else start_ms))
    number = F.when(wanted & ~F.isnan("value"), F.col("value"))
    closed = stream.withWatermark("ts", _interval(s.watermark_ms)).groupBy(
        *(F.when(wanted, F.col(k)).alias(k) for k in keys), slices
    ).agg(F.avg(number).alias("current_load"), F.count(F.when(wanted, 1)).alias("readings_count"))
    return closed.where("readings_count > 0").select(
        *keys, slice_index(F.unix_millis("window.start"), s).alias("slice_idx"), "current_load", "readings_count"
    )


def prepare_history(archive: DataFrame, keys: Sequence[str], s: Settings, folder: str) -> None:
    """Write the slice averages of ``start_days`` days before live_start, the starting history of ``stream_prediction``."""
    first = s.live_start_ms + (s.lookahead_slices - s.start_days * s.slices_per_day) * s.slice_ms
    rows = slice_rows(between(archive, first, s.live_start_ms), s)
    _store_averages(key_averages(rows, keys, s), s, folder, -1)


def _store_averages(averages: DataFrame, s: Settings, folder: str, batch_id: int) -> None:
    """Put averages into the folders of their days; those of the same batch and day are replaced."""
    dated = averages.withColumn("day", day_of(F.col("slice_idx"), s)).withColumn("batch", F.lit(batch_id))
    dated = dated.repartitionByRange("day", "slice_idx")
    writer = dated.write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{folder}/averages")


def _stored_averages(spark: SparkSession, folder: str, schema: str, days: Sequence[int]) -> DataFrame:
    """Averages of the given days; only their folders are listed. A batch and a merged copy of it count once."""
    there = set(subfolders(spark, f"{folder}/averages"))
    paths = [f"{folder}/averages/day={d}" for d in days if f"day={d}" in there]
    if not paths:
        return _empty(spark, schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/averages").parquet(*paths)


def _tidy_averages(spark: SparkSession, folder: str, schema: str, keys: Sequence[str], s: Settings, first: int, batch_id: int) -> None:
    """Remove days that no later slice needs and merge the batches of each complete day into one.

    The merged copy is written before the batches are removed; readers drop repeated averages, so a failure between
    the two does no harm.
    """
    for name in subfolders(spark, f"{folder}/averages"):
        day = int(name.split("=")[1])
        path = f"{folder}/averages/{name}"
        if day < first - s.history_days:
            remove(spark, path)
        elif day < first and len(batches := subfolders(spark, path)) > 1:
            every = _stored_averages(spark, folder, schema, [day]).dropDuplicates([*keys, "slice_idx"])
            _store_averages(every.drop("day", "batch"), s, folder, -2 - batch_id)
            for old in batches:
                remove(spark, f"{path}/{old}")


def stream_prediction(
    stream: DataFrame, keys: Sequence[str], s: Settings, folder: str, state: str,
    available_now: bool = False, every: str = "1 minute",
) -> StreamingQuery:
    """Predictions for each closed slice, written to folder/predictions/batch=<id>.

    The history is the table folder/averages: the averages of the archive (``prepare_history``) and those of every
    slice closed since, so live data become history a day later and no raw reading is read again. The table has a
    folder per day: a batch lists and reads only the days it needs, complete days are merged, days beyond the history
    are removed. Writing a batch again replaces its folders: a retry leaves no duplicates. ``eval_ms`` is the time
    at which a batch was evaluated, for ``sinks.with_latency``.
    """
    spark = stream.sparkSession
    key_types = ", ".join(f"{k} int" for k in keys)
    columns = f"{key_types}, slice_idx bigint, average_load double, readings_count bigint, day int, batch bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/predictions/batch={batch_id}"
        _store_averages(batch.withColumnRenamed("current_load", "average_load"), s, folder, batch_id)
        newest = [int(n.split("=")[1]) for n in subfolders(spark, f"{folder}/averages")]
        newest = [d for d in newest if f"batch={batch_id}" in subfolders(spark, f"{folder}/averages/day={d}")]
        if not newest:
            _empty(spark, f"{key_types}, {PREDICTION}").write.mode("overwrite").parquet(target)
            return
        current = _stored_averages(spark, folder, columns, newest).where(F.col("batch") == batch_id).drop("batch", "day")
        ahead = -(-s.lookahead_slices // s.slices_per_day)
        days = range(min(newest) - s.history_days, max(newest) + ahead)
        history = _stored_averages(spark, folder, columns, days).drop("batch", "day").dropDuplicates([*keys, "slice_idx"])
        joined = history_median(history, current.withColumnRenamed("average_load", "current_load"), keys, s)
        result = joined.withColumn("predicted_load", predicted(F.col("history_median"), F.col("current_load")))
        result = result.withColumn("time_slice", slice_label(F.col("target_slice"), s))
        result.withColumn("eval_ms", F.lit(round(time() * 1000))).write.mode("overwrite").parquet(target)
        _tidy_averages(spark, folder, columns, keys, s, min(newest), batch_id)

    return (
        slice_averages(stream, keys, s).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", state).trigger(**_trigger(available_now, every)).start()
    )


def pane_histogram(stream: DataFrame, slide_ms: int, s: Settings) -> DataFrame:
    """Value counts per plug and closed pane of one slide. State rows are (plug, pane, value): each reading is counted
    once, whatever the width of the windows. Any reading moves the watermark, as in ``slice_averages``."""
    if s.window_ms % slide_ms:
        raise ValueError("the slide must divide the width")
    wanted = _load(s, limited=False) & F.col("value").isNotNull() & ~F.isnan("value")
    names = [*PLUG, "value"]
    counted = stream.withWatermark("ts", _interval(s.watermark_ms)).groupBy(
        F.window("ts", _interval(slide_ms)), *(F.when(wanted, F.col(k)).alias(k) for k in names)
    ).agg(F.count(F.when(wanted, 1)).alias("n"))
    return counted.where("n > 0").select(*PLUG, F.unix_millis("window.end").alias("pane_end"), "value", "n")


def stream_outliers(
    stream: DataFrame, slide_ms: int, s: Settings, folder: str, state: str,
    available_now: bool = False, every: str = "1 minute",
) -> StreamingQuery:
    """Percentage changes per house for each closed window, written to folder/changes/batch=<id>.

    Value counts of closed panes are stored at doubling widths (``panes``), and a batch builds the windows that have
    become complete from a few of them, whatever the width; a window is complete once a pane that ends with it or later
    has closed. The last flag of every plug is kept as a
    table, one version per micro-batch (folder/flags/batch=<id>); it never expires. A batch reads version id - 1
    and replaces version id, so a retry gives the same result. What a retry cannot need is removed when the next
    batch begins, so the folder holds the panes of one width and two versions of the flags, however long the stream
    runs. All steps are distributed over plugs, values and blocks; nothing is kept per house.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{folder}/panes/{part}")
        own = spark.read.schema(batch.schema).parquet(f"{folder}/panes/{part}")
        known, kept = _known_flags(spark, folder, batch_id), _known_panes(spark, folder, batch_id)
        oldest, newest = own.agg(F.min("pane_end"), F.max("pane_end")).first()
        before = max(kept.values(), default=None)
        _tidy_outliers(spark, folder, batch_id, kept)
        if newest is None:
            _remember_panes(spark, folder, batch_id, kept)
            known.write.mode("overwrite").parquet(f"{folder}/flags/{part}")
            _empty(spark, CHANGES).write.mode("overwrite").parquet(f"{folder}/changes/{part}")
            return
        first = oldest if before is None else before + slide_ms
        _store_nodes(spark, folder, batch_id, own, kept, first, newest, slide_ms, s)
        number = lambda ms: ms // slide_ms
        width, ranges = number(s.window_ms), _pane_ranges({**kept, batch_id: newest}, slide_ms)
        top = top_level(width)
        nodes = _nodes(spark, folder, needed(ranges, number(first), number(newest), width, top))
        windows = windows_of_nodes(nodes, number(first), number(newest), width, top)
        windows = windows.withColumn("window_end", F.col("window") * slide_ms).drop("window")
        windows.write.mode("overwrite").parquet(f"{folder}/histogram/{part}")
        hist = spark.read.parquet(f"{folder}/histogram/{part}")
        rows = hist.count()  # from the Parquet footers
        # The whole batch bounds every group; if that is no proof of small groups they are counted one by one.
        sizes = Sizes(rows, rows, rows, rows, rows) if rows <= s.window_rows else None
        grid_flags(hist, s, sizes).write.mode("overwrite").parquet(f"{folder}/windows/{part}")
        flags = spark.read.parquet(f"{folder}/windows/{part}")
        latest = flags.groupBy(*PLUG).agg(F.max_by("flag", "window_end").alias("flag"))
        silent = known.join(latest, PLUG, "left_anti")
        latest.unionByName(silent).write.mode("overwrite").parquet(f"{folder}/flags/{part}")

        most = sizes.house if sizes else None
        result = continued_percentages(continued_changes(flags, known, s, most), known, s, most)
        result = result.withColumn("time_frame", time_frame(F.col("window_end"), s.window_ms))
        result.withColumn("eval_ms", F.lit(round(time() * 1000))).write.mode("overwrite").parquet(f"{folder}/changes/{part}")
        _remember_panes(spark, folder, batch_id, {b: end for b, end in {**kept, batch_id: newest}.items() if end > newest - s.window_ms})

    return (
        pane_histogram(stream, slide_ms, s).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", state).trigger(**_trigger(available_now, every)).start()
    )


NODES = "house_id int, household_id int, plug_id int, value double, n bigint, node bigint, batch bigint, level int"


def _pane_ranges(kept: dict[int, int], slide_ms: int) -> dict[int, tuple[int, int]]:
    """Panes of each batch as (before, newest): a batch begins where the one before it ends."""
    ends = sorted((end // slide_ms, batch) for batch, end in kept.items())
    starts = [0, *(end for end, _ in ends[:-1])]
    return {batch: (start, end) for start, (end, batch) in zip(starts, ends)}


def _nodes(spark: SparkSession, folder: str, folders: Sequence[tuple[int, int]]) -> DataFrame:
    """Stored nodes of the given (batch, level) folders; nothing is listed but these."""
    paths = [f"{folder}/nodes/batch={b}/level={level}" for b, level in folders]
    paths = [p for p in paths if is_folder(spark, p)]
    if not paths:
        return _empty(spark, NODES)
    return spark.read.schema(NODES).option("basePath", f"{folder}/nodes").parquet(*paths)


def _store_nodes(
    spark: SparkSession, folder: str, batch_id: int, own: DataFrame, kept: dict[int, int], first: int, newest: int, slide_ms: int, s: Settings
) -> None:
    """Write the nodes that the panes of a batch complete, with what they take in from batches before."""
    before, last, top = first // slide_ms - 1, newest // slide_ms, top_level(s.window_ms // slide_ms)
    ranges = _pane_ranges(kept, slide_ms)
    wanted = left_of(before, last, top)
    place = {}
    for level, node in wanted:
        end = (node + 1) << level
        place.update({(b, level): True for b, (low, high) in ranges.items() if low < end <= high})
    stored = _nodes(spark, folder, list(place))
    is_wanted = [(F.col("level") == level) & (F.col("node") == node) for level, node in wanted]
    stored = stored.where(reduce(or_, is_wanted)) if wanted else stored
    fresh = own.withColumn("pane", (F.col("pane_end") / slide_ms).cast("long") - 1)
    made = new_nodes(fresh, stored, before, last, top)
    made.repartition("level", "node").write.partitionBy("level").mode("overwrite").parquet(f"{folder}/nodes/batch={batch_id}")


def _known_panes(spark: SparkSession, folder: str, batch_id: int) -> dict[int, int]:
    """Batches whose panes later windows may need, and where their last pane ends; at most width / slide and one."""
    if batch_id == 0:
        return {}
    rows = spark.read.schema("pane_batch bigint, newest bigint").parquet(f"{folder}/kept/batch={batch_id - 1}").collect()
    return {r["pane_batch"]: r["newest"] for r in rows}


def _remember_panes(spark: SparkSession, folder: str, batch_id: int, kept: dict[int, int]) -> None:
    rows = spark.createDataFrame(list(kept.items()), "pane_batch bigint, newest bigint")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/kept/batch={batch_id}")


def _tidy_outliers(spark: SparkSession, folder: str, batch_id: int, kept: dict[int, int]) -> None:
    """Remove what batches before the last one left and no later batch reads."""
    for table, oldest in (("flags", batch_id - 1), ("kept", batch_id - 1), ("histogram", batch_id), ("windows", batch_id), ("panes", batch_id), ("nodes", batch_id)):
        for name in subfolders(spark, f"{folder}/{table}"):
            number = int(name.split("=")[1])
            if number < oldest and not (table == "nodes" and number in kept):
                remove(spark, f"{folder}/{table}/{name}")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    columns = [part.split() for part in schema.split(", ")]
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in columns))


def _known_flags(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return _empty(spark, FLAGS)
    return spark.read.schema(FLAGS).parquet(f"{folder}/flags/batch={batch_id - 1}")


def continued_changes(flags: DataFrame, known: DataFrame, s: Settings, largest: int | None = None) -> DataFrame:
    """Flag changes of a batch; the known flags stand before the first window of the batch.

    A plug has one row per window of the batch and one known flag.
    """
    before = known.select(*PLUG, F.lit(-1).cast("long").alias("window_end"), "flag")
    every = flags.select(*PLUG, "window_end", "flag").unionByName(before)
    return flag_changes(every, ["window_end"], s, largest).where("window_end >= 0")


def continued_percentages(
    changes: DataFrame, known: DataFrame, s: Settings, largest: int | None = None
) -> DataFrame:
    """Percentages after each change, starting from the totals of the known flags of the house."""
    order = ["window_end", "household_id", "plug_id"]
    totals = known.groupBy(*HOUSE).agg(
        F.count_if("flag").alias("known_above"), F.count("*").alias("known_plugs")
    )
    moved = running(changes, HOUSE, order, s, sums=count_moves(), largest=largest)
    moved = moved.join(totals, HOUSE, "left").na.fill(0, ["known_above", "known_plugs"])
    above_count, plug_count = F.col("above_count") + F.col("known_above"), F.col("plug_count") + F.col("known_plugs")
    return moved.select(
        *PLUG, "window_end", "flag", above_count.alias("above_count"), plug_count.alias("plug_count"),
        (above_count * 100.0 / plug_count).alias("percentage"),
    )
