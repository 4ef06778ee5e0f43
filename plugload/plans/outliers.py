"""Share of plugs per house whose sliding median load exceeds the median over all plugs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plugload.functions.columns import above, share_of_true, time_frame
from plugload.operators.blocks import running
from plugload.operators.medians import grid_median, median_of_histogram
from plugload.operators.sliding import sliding_median, span_widths
from plugload.schema import HOUSE, PLUG
from plugload.session import materialized
from plugload.settings import DAY_MS, Settings
from plugload.sources.readings import load_only


@dataclass(frozen=True)
class Sizes:
    """Row counts that decide between plain and block-wise plans."""

    rows: int
    time_span: int  # rows of the largest time span over all plugs
    plug_span: int  # rows of the largest (plug, span)
    plug: int
    house: int


def measure(load: DataFrame, width_ms: int) -> Sizes:
    """All sizes in one pass: counts per plug and width first, then sums of these counts along four groupings."""
    fine = load.groupBy(*PLUG, F.floor(F.col("ts_ms") / width_ms).alias("span")).agg(F.count("*").alias("n"))
    fine = fine.withColumn("long_span", F.floor(F.col("span") / span_widths(PLUG)))
    plug = [F.col(k) for k in PLUG]
    sums = fine.groupingSets(
        [[F.col("span")], [*plug, F.col("long_span")], plug, [F.col("house_id")]],
        *plug, F.col("span"), F.col("long_span"),
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("by"))
    # Bits of grouping_id, highest first: house, household, plug, span, long_span; a set bit is left out.
    by = {row["by"]: row for row in sums.groupBy("by").agg(F.max("n").alias("most"), F.sum("n").alias("rows")).collect()}
    most = lambda bits: by[bits]["most"] if bits in by else 0
    rows = by[0b11101]["rows"] if by else 0
    return Sizes(rows, most(0b11101), most(0b00010), most(0b00011), most(0b01111))


def global_median(readings: DataFrame, s: Settings, sizes: Sizes | None = None) -> DataFrame:
    """Median over all plugs in the window ending at each distinct reading time."""
    known = (sizes.rows, sizes.time_span) if sizes else None
    medians = sliding_median(load_only(readings), [], s.window_ms, s, known)
    return medians.select("ts_ms", F.col("median").alias("global_median"))


def plug_median(readings: DataFrame, s: Settings, sizes: Sizes | None = None) -> DataFrame:
    """Median of each plug in the window ending at each of its distinct reading times."""
    known = (sizes.rows, sizes.plug_span) if sizes else None
    medians = sliding_median(load_only(readings), PLUG, s.window_ms, s, known)
    return medians.select(*PLUG, "ts_ms", F.col("first_id").alias("id"), F.col("median").alias("plug_median"))


def with_global_median(readings: DataFrame, s: Settings) -> DataFrame:
    """Every load reading with the global median at its time. The join side has one row per time."""
    return load_only(readings).join(global_median(readings, s), "ts_ms")


def plug_flags(readings: DataFrame, s: Settings, sizes: Sizes | None = None) -> DataFrame:
    """Per plug and reading time the flag "plug median above global median".

    Both medians depend on the time only, so readings of one plug in the same millisecond share one row; its id is
    the smallest of them, the reading at which a change would be seen first. A window without value has no median and
    gives no flag.
    """
    sizes = sizes or measure(load_only(readings), s.window_ms)
    plugs = plug_median(readings, s, sizes).where("plug_median is not null")
    flags = plugs.join(global_median(readings, s, sizes), "ts_ms")
    return flags.withColumn("flag", above(F.col("plug_median"), F.col("global_median")))


def flag_changes(flags: DataFrame, order: Sequence[str], s: Settings, largest: int | None = None) -> DataFrame:
    """Rows where the flag of a plug is new or differs from its previous one; column previous_flag."""
    with_previous = running(flags, PLUG, order, s, previous={"previous_flag": F.col("flag")}, largest=largest)
    return with_previous.where("previous_flag is null or previous_flag <> flag")


def count_moves() -> dict[str, Column]:
    """What one change adds to the flagged plugs and to the plugs of its house."""
    new = F.col("previous_flag").isNull()
    up = F.when(new, F.col("flag").cast("long")).otherwise(F.when(F.col("flag"), 1).otherwise(-1))
    return {"above_count": up.cast("long"), "plug_count": F.when(new, 1).otherwise(0).cast("long")}


def percentages(changes: DataFrame, order: Sequence[str], s: Settings, largest: int | None = None) -> DataFrame:
    """Percentage of flagged plugs of the house after each change, over all plugs seen so far.

    A change moves the count of flagged plugs by one; a new plug also raises the number of plugs. So the state of a
    house at any moment is two running sums.
    """
    totals = running(changes, HOUSE, order, s, sums=count_moves(), largest=largest)
    return totals.withColumn("percentage", F.col("above_count") * 100.0 / F.col("plug_count"))


def outliers(readings: DataFrame, s: Settings) -> DataFrame:
    """Change events of the percentage per house, in the order (ts_ms, id), with the time frame of the window."""
    # Flags and changes are at most as many as readings, so the sizes of the readings bound all later groups.
    sizes = measure(load_only(readings), s.window_ms)
    changes = flag_changes(plug_flags(readings, s, sizes), ["ts_ms"], s, sizes.plug)
    result = percentages(changes, ["ts_ms", "id"], s, sizes.house)
    return result.withColumn("time_frame", time_frame(F.col("ts_ms"), s.window_ms))


def q2a(readings: DataFrame, s: Settings) -> DataFrame:
    return outliers(readings, s)


def q2b(readings: DataFrame, s: Settings) -> DataFrame:
    return outliers(readings, s.with_window(DAY_MS))


def flag_snapshot(flags: DataFrame) -> DataFrame:
    """Latest flag of every plug."""
    latest = F.struct("ts_ms", "id")
    return flags.groupBy(*PLUG).agg(F.max_by("flag", latest).alias("flag"), F.max("ts_ms").alias("ts_ms"))


def snapshot_percentage(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy(*HOUSE).agg(share_of_true(F.col("flag")).alias("percentage"), F.count("*").alias("plug_count"))


def grid_flags(hist: DataFrame, s: Settings, sizes: Sizes | None = None) -> DataFrame:
    """Flags per plug and window end from a histogram (plug, window_end, value, n).

    ``sizes`` are bounds of the histogram groups if known: plug_span per (plug, window), time_span per window.
    """
    proven = lambda n: n if n <= s.window_rows else None
    per_plug, per_window = (proven(sizes.plug_span), proven(sizes.time_span)) if sizes else (None, None)
    plugs = median_of_histogram(hist, [*PLUG, "window_end"], s, largest=per_plug)
    all_plugs = hist.groupBy("window_end", "value").agg(F.sum("n").alias("n"))
    overall = median_of_histogram(all_plugs, ["window_end"], s, largest=per_window)
    flags = plugs.select(*PLUG, "window_end", F.col("median").alias("plug_median")).join(
        overall.select("window_end", F.col("median").alias("global_median")), "window_end"
    )
    return flags.withColumn("flag", above(F.col("plug_median"), F.col("global_median")))


def grid_outliers(readings: DataFrame, slide_ms: int, s: Settings) -> DataFrame:
    """Change events on a grid of windows, in the order (window_end, household, plug) within a house.

    Flags are written once; their number, read from the footers, bounds all later groups.
    """
    load = load_only(readings)
    plugs = grid_median(load, PLUG, s.window_ms, slide_ms, s).select(*PLUG, "window_end", F.col("median").alias("plug_median"))
    overall = grid_median(load, [], s.window_ms, slide_ms, s).select("window_end", F.col("median").alias("global_median"))
    flags = plugs.join(overall, "window_end").withColumn("flag", above(F.col("plug_median"), F.col("global_median")))
    flags = materialized(flags)
    rows = flags.count()
    most = rows if rows <= s.window_rows else None
    changes = flag_changes(flags, ["window_end"], s, most)
    return percentages(changes, ["window_end", "household_id", "plug_id"], s, most)
