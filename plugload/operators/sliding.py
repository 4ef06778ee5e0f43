"""Exact sliding-window median at every reading: window (t - width, t], per key or over all readings.

Time is cut into spans that are multiples of the width; a reading also goes into the next span if a window
there can reach it. Spans are independent, so the work spreads over keys and time.

* Usual case: a (key, span) has at most ``group_rows`` rows, and SPAN_ROWS whatever these are. Such spans are packed by
  hash into Python groups of about PACK_ROWS rows and one numpy pass answers all windows of a pack.
* Dense case: larger spans go through ``_dense_medians``, which never puts a whole window into one task. The windows at consecutive readings differ by few rows, so for a block of readings only the rows that
  enter or leave during the block and a thin band of values around the median are needed; the rest is counted.

So the rows of a Python group do not grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from plugload.functions.ranks import select_in_ranges
from plugload.operators.blocks import in_blocks
from plugload.session import materialized
from plugload.settings import Settings

# Row kinds inside a group. OWN rows belong to the span and ask for a median; PREVIOUS rows come from the time
# before it; CORE rows are values present in every window of a block; BELOW and ABOVE carry the number of further
# values under and over the band; SKIP names a time answered by a later block; EARLIER brings
# the smallest id of that time to the block that answers it.
OWN, PREVIOUS, CORE, BELOW, ABOVE, SKIP, EARLIER = range(7)

# Rows of a Python group: of a span that is answered whole, and of what is packed together.
SPAN_ROWS = 1 << 17
PACK_ROWS = 1 << 16
# Values that a bin of a dense span gives to the chunks of the span, per task of the join.
SALT_ROWS = 1 << 18
# Tables of small rows are broadcast up to this many rows: the dense spans, at most 2 * rows / limit, and the
# bins, 2 * rows / block and some more where spans end inside a block.
BROADCAST_ROWS = 200_000


def span_widths(keys: Sequence[str]) -> int:
    """Widths per span: longer spans of single keys copy fewer rows, all rows together need short ones."""
    return 24 if keys else 1


def dense_block_rows(most: int, s: Settings) -> int:
    """Rows of a block of dense spans of at most ``most`` rows, a power of two.

    Two blocks' events fit into a Python group. A block is at least twice the square root of a span, as a span has a cell
    per pair of blocks: there are then a quarter as many cells as rows, whatever ``block_rows`` is.
    """
    root = 1 << (max(most - 1, 0).bit_length() + 1) // 2
    return max(min(s.block_rows, PACK_ROWS // 2), 2 * root)


def span_sizes(df: DataFrame, keys: Sequence[str], width_ms: int) -> DataFrame:
    span = F.floor(F.col("ts_ms") / (width_ms * span_widths(keys))).alias("span")
    return df.groupBy(*keys, span).count()


def sliding_median(
    df: DataFrame, keys: Sequence[str], width_ms: int, s: Settings, sizes: tuple[int, int] | None = None,
    since: int | None = None,
) -> DataFrame:
    """Columns keys, ts_ms, median, first_id: one row per distinct (key, ts_ms), first_id the smallest id there.

    ``df`` needs keys, ts_ms, value and id. Rows with the same millisecond see each other. Null and NaN values are
    not counted; a window without values has a null median. ``sizes`` are the number of rows and the rows of the
    largest (key, span) if known, otherwise they are counted. With ``since`` only times from there on are answered.
    """
    if since is not None:
        return _sliding_median(df, list(keys), width_ms, s, sizes, since).where(F.col("ts_ms") >= since)
    return _sliding_median(df, list(keys), width_ms, s, sizes)


def _sliding_median(df: DataFrame, keys: list[str], width_ms: int, s: Settings, sizes=None, since: int | None = None) -> DataFrame:
    number = F.when(~F.isnan("value"), F.col("value")).alias("value")
    rows = df.select(*keys, "ts_ms", number, "id")
    span_ms = width_ms * span_widths(keys)
    spans = span_sizes(rows, keys, width_ms)
    total, largest = sizes or spans.agg(F.sum("count"), F.max("count")).first()
    total, largest = total or 0, largest or 0
    packs = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PACK_ROWS))
    spread = _into_spans(rows, width_ms, span_ms)
    if since is not None:  # earlier rows only fill windows
        spread = spread.withColumn("kind", F.when(F.col("ts_ms") < since, F.lit(PREVIOUS)).otherwise(F.col("kind")))
    limit = min(s.group_rows, SPAN_ROWS)
    if 2 * largest <= limit:  # a span and what it copies from the one before
        return _packed_medians(spread, keys, width_ms, packs)

    reached = F.explode(F.array("span", F.col("span") + 1)).alias("span")
    dense = spans.select(*keys, reached, "count").groupBy(*keys, "span").agg(F.sum("count").alias("count"))
    dense = dense.where(F.col("count") > limit).select(*keys, F.col("span").alias("long_span"))
    if 2 * total // limit <= BROADCAST_ROWS:
        dense = F.broadcast(dense)
    on = [*keys, "long_span"]
    usual = spread.withColumn("long_span", F.col("span")).join(dense, on, "left_anti").drop("long_span")
    narrow = _into_spans(rows, width_ms, width_ms)
    narrow = narrow.withColumn("long_span", F.floor(F.col("span") / span_widths(keys)))
    narrow = narrow.join(dense, on, "left_semi").drop("long_span")
    return _packed_medians(usual, keys, width_ms, packs).unionByName(_dense_medians(narrow, keys, width_ms, total, 2 * largest, s))


def _into_spans(rows: DataFrame, width_ms: int, span_ms: int) -> DataFrame:
    """Each row with its own span, and again with the next span if a window there reaches back to it."""
    own = F.floor(F.col("ts_ms") / span_ms)
    reaches = F.col("ts_ms") + width_ms > (own + 1) * span_ms
    both = F.array(
        F.struct(own.alias("span"), F.lit(OWN).alias("kind")),
        F.struct((own + 1).alias("span"), F.lit(PREVIOUS).alias("kind")),
    )
    only = F.array(F.struct(own.alias("span"), F.lit(OWN).alias("kind")))
    return rows.withColumn("at", F.explode(F.when(reaches, both).otherwise(only))).select(
        *rows.columns, "at.span", "at.kind"
    )


def _schema(df: DataFrame, keys: list[str]) -> str:
    parts = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    return ", ".join([*parts, "ts_ms bigint", "median double", "first_id bigint"])


def _packed_medians(spread: DataFrame, keys: list[str], width_ms: int, packs: int) -> DataFrame:
    pack = F.pmod(F.xxhash64(*keys, "span"), F.lit(packs))
    rows = spread.select(*keys, "span", "ts_ms", "value", F.col("kind").cast("byte").alias("kind"), "id")
    return rows.groupBy(pack).applyInPandas(_answer(keys, width_ms, [*keys, "span"]), _schema(spread, keys))


def _dense_medians(spread: DataFrame, keys: list[str], width_ms: int, total: int, most: int, s: Settings) -> DataFrame:
    """Sliding medians for windows of any size; every task sees at most a few blocks of rows, or a pack of small blocks.

    1. Number blocks along (key, span, value) -> ``bin`` and along (key, span, event time) -> ``chunk``. Here a
       span is one width, so an OWN row only enters and a PREVIOUS row only leaves during it: one event each.
    2. Count the core of each chunk per bin: OWN rows of earlier chunks, PREVIOUS rows of later chunks.
    3. With d events in a chunk the median can only be a core value whose core rank is within d/2 of the middle,
       or an event value. Keep the bins that cover these ranks as the band, count what lies below and above.
    4. Send the band's core values to the chunk and let the numpy pass answer its readings, those of several small
       chunks at once.

    Step 2 and 3 work on summaries of (rows of two widths / block) squared cells per (key, span), see
    ``dense_block_rows``. ``most`` bounds the rows of two widths.
    """
    group, block = [*keys, "span"], dense_block_rows(most, s)
    leaves = F.col("kind") == PREVIOUS
    event = F.when(leaves, F.col("ts_ms") + width_ms).otherwise(F.col("ts_ms"))
    spread = in_blocks(spread.withColumn("event", event), [*group, "value", "ts_ms", "id"], block, "bin")
    # Leaving rows first: the last chunk with a given event time then holds an entering row, if there is any.
    spread = spread.withColumn("phase", -F.col("kind"))
    spread = materialized(in_blocks(spread, [*group, "event", "phase", "id"], block, "chunk"))

    along = Window.partitionBy(*group).orderBy("chunk")
    chunks = materialized(
        spread.groupBy(*group, "chunk")
        .agg(
            F.min("event").alias("first"), F.max("event").alias("last"), F.count("value").alias("events"),
            F.min(F.when(~leaves, F.struct((-F.col("event")).alias("at"), "id"))).alias("newest"),
        )
        .withColumn("continued", F.lead("first").over(along) == F.col("last"))
        .withColumn("no", F.row_number().over(along))
    )
    # A chunk whose readings all continue in the next one has nothing to answer.
    asked = chunks.where("first <> last or not coalesce(continued, false)")

    counts = (
        spread.groupBy(*group, "bin", "chunk").agg(
            F.count(F.when(~leaves, F.col("value"))).alias("entering"),
            F.count(F.when(leaves, F.col("value"))).alias("leaving"),
        )
        .join(chunks.select(*group, "chunk", "no"), [*group, "chunk"]).drop("chunk")
    )
    # Every bin needs a count for every chunk of its span, also where no event of the chunk lies in the bin.
    last_no = chunks.groupBy(*group).agg(F.max("no").alias("last_no"))
    # The number of parts is given, as a few bins make many cells.
    parts = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = counts.select(*group, "bin").distinct().join(last_no, group).repartition(parts, *group, "bin").select(
        *group, "bin", F.explode(F.sequence(F.lit(1), "last_no")).alias("no")
    )
    cells = cells.join(counts, [*group, "bin", "no"], "left").na.fill(0, ["entering", "leaving"])
    over_chunks = Window.partitionBy(*group, "bin").orderBy("no")
    core = F.coalesce(
        F.sum("entering").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ) + F.coalesce(F.sum("leaving").over(over_chunks.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    over_bins = Window.partitionBy(*group, "chunk").orderBy("bin")
    ranked = cells.withColumn("core", core).join(asked, [*group, "no"])
    ranked = ranked.withColumn(
        "under", F.coalesce(F.sum("core").over(over_bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("size", F.sum("core").over(Window.partitionBy(*group, "chunk")))
    ranked = materialized(ranked.drop("entering", "leaving"))
    lowest = (F.col("size") - F.col("events")) / 2 - 2
    highest = (F.col("size") + F.col("events")) / 2 + 1
    in_band = (F.col("core") > 0) & (F.col("under") + F.col("core") > lowest) & (F.col("under") <= highest)
    band = ranked.where(in_band)

    none = F.lit(None).cast("long")
    shape = lambda ts, value, n, kind, id_: [
        *group, "chunk", ts.alias("ts_ms"), value.cast("double").alias("value"), n.cast("long").alias("n"),
        F.lit(kind).alias("kind") if isinstance(kind, int) else kind.alias("kind"), id_.alias("id"),
    ]
    events = spread.select(*shape(F.col("ts_ms"), F.col("value"), F.lit(1), F.col("kind"), F.col("id")))

    # The middle bins meet every chunk of a span, so each gives about as many values as the span has rows: salt them so
    # that the join output spreads.
    salts = min(1024, -(-most // SALT_ROWS))
    wanted = band.select(*group, "bin", F.col("chunk").alias("for_chunk"), "first").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    present = F.when(F.col("kind") == PREVIOUS, F.col("chunk") > F.col("for_chunk")).otherwise(
        F.col("chunk") < F.col("for_chunk")
    )
    bins = band.select(*group, "bin").distinct()
    if 2 * total // block <= BROADCAST_ROWS:
        bins = F.broadcast(bins)
    core_values = (
        spread.where("value is not null").join(bins, [*group, "bin"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        .join(wanted, [*group, "bin", "salt"]).where(present)
        .groupBy(*group, F.col("for_chunk").alias("chunk"), "first", "value").agg(F.count("*").alias("n"))
        .select(*shape(F.col("first"), F.col("value"), F.col("n"), CORE, none))
    )
    outside = ranked.groupBy(*group, "chunk", "first", "last", "continued", "size").agg(
        F.min(F.when(in_band, F.col("under"))).alias("below"), F.max(F.when(in_band, F.col("under") + F.col("core"))).alias("upto")
    )
    zero = F.lit(0.0)
    below = outside.where("below > 0").select(*shape(F.col("first"), zero, F.col("below"), BELOW, none))
    over = outside.where("size > upto").select(*shape(F.col("first"), zero, F.col("size") - F.col("upto"), ABOVE, none))
    skip = outside.where("continued").select(*shape(F.col("last"), zero, F.lit(0), SKIP, none))

    earlier = (
        chunks.where("continued and newest.at = -last").groupBy(*group, F.col("last").alias("first"))
        .agg(F.min("newest.id").alias("id")).join(asked.select(*group, "chunk", "first"), [*group, "first"])
        .select(*shape(F.col("first"), zero, F.lit(0), EARLIER, F.col("id")))
    )

    asked_events = events.join(asked.select(*group, "chunk"), [*group, "chunk"], "left_semi")
    parts = asked_events.unionByName(core_values).unionByName(below).unionByName(over).unionByName(skip)
    parts = parts.unionByName(earlier)
    pack = F.shiftright("chunk", (PACK_ROWS // block).bit_length() - 1 if block < PACK_ROWS else 0)
    return parts.groupBy(pack).applyInPandas(_answer(keys, width_ms, [*group, "chunk"]), _schema(spread, keys))


def _answer(keys: list[str], width_ms: int, group: list[str]):
    """Function that answers all readings of a pandas group holding one or more groups by the columns ``group``."""
    result = [*keys, "ts_ms", "median", "first_id"]

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort([pdf[c].to_numpy() for c in ["ts_ms", *reversed(group)]])].reset_index(drop=True)
        ts, kind = pdf["ts_ms"].to_numpy(), pdf["kind"].to_numpy()
        value = pdf["value"].to_numpy(dtype=float)
        n = pdf["n"].to_numpy() if "n" in pdf else np.ones(len(pdf), dtype=np.int64)
        changed = np.zeros(len(pdf), dtype=bool)
        changed[0] = True
        for c in group:
            col = pdf[c].to_numpy()
            changed[1:] |= col[1:] != col[:-1]
        gid = np.cumsum(changed) - 1
        groups = gid[-1] + 1
        below = np.bincount(gid, np.where(kind == BELOW, n, 0), groups).astype(np.int64)
        above = np.bincount(gid, np.where(kind == ABOVE, n, 0), groups).astype(np.int64)

        # One sortable position per (group, time); the gap of width + 2 keeps windows inside their group.
        offset = ts - ts[changed][gid]
        step = int(offset.max()) + width_ms + 2
        position = gid * step + offset

        asks = (kind == OWN) | (kind == EARLIER)
        first_at = pdf[asks].groupby(position[asks], sort=True)["id"].min()
        at, first_id = first_at.index.to_numpy(), first_at.to_numpy()
        answered = ~np.isin(at, position[kind == SKIP])
        at, first_id = at[answered], first_id[answered]

        points = (kind <= CORE) & ~np.isnan(value)
        if not points.any():
            row = np.searchsorted(position, at)
            out = pdf.loc[row, [*keys, "ts_ms"]].assign(median=np.nan, first_id=first_id)
            return out[result]
        where, weight = position[points], n[points]
        levels, codes = np.unique(value[points], return_inverse=True)
        cumulative = np.concatenate(([0], np.cumsum(weight)))
        start = at // step * step
        lo = np.searchsorted(where, np.maximum(at - width_ms, start - 1), "right")
        hi = np.searchsorted(where, at, "right")
        inside = cumulative[hi] - cumulative[lo]
        at_group = at // step
        size = inside + below[at_group] + above[at_group]
        some = size > 0
        median = np.full(len(at), np.nan)
        if some.any():
            lo, hi, size, under = lo[some], hi[some], size[some], below[at_group[some]]
            # Lower and upper middle value in one descent; they are the same row if the size is odd.
            even = np.flatnonzero(size % 2 == 0)
            ranks = np.concatenate(((size - 1) // 2 - under, size[even] // 2 - under[even]))
            found = select_in_ranges(
                codes, weight, np.concatenate((lo, lo[even])), np.concatenate((hi, hi[even])), ranks
            )
            lower = levels[found[: len(size)]]
            upper = lower.copy()
            upper[even] = levels[found[len(size):]]
            median[some] = (lower + upper) / 2
        out = pdf.loc[np.searchsorted(position, at), [*keys, "ts_ms"]]
        return out.assign(median=median, first_id=first_id)[result]

    return answer
