"""Histograms of closed panes at doubling widths, so that a long window is the sum of a few of them.

Panes are numbered by time. A node (level, number) holds the value counts of the 2^level panes from number * 2^level on. It is
stored with the micro-batch that closes its last pane, under ``batch=<id>/level=<level>``. A window of w panes is the union
of at most 2 log2(w) nodes: those inside it whose parent is not.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from plugload.schema import PLUG


def top_level(width: int) -> int:
    """Level of the largest nodes that fit into a window of so many panes."""
    return width.bit_length() - 1


def new_nodes(fresh: DataFrame, stored: DataFrame, before: int, newest: int, top: int) -> DataFrame:
    """Nodes whose last pane lies in [before, newest): plug, value, n, level, node.

    ``fresh`` are the value counts of these panes (column pane), ``stored`` the nodes of ``left_of`` for the parts that
    lie before them.
    """
    rows = fresh.select(*PLUG, "value", "n", F.lit(0).alias("level"), F.col("pane").alias("node"), F.lit(0).alias("low"))
    older = stored.select(*PLUG, "value", "n", "level", "node", (F.col("level") + 1).alias("low"))
    rows = rows.unionByName(older).where(F.col("low") <= top).withColumn("up", F.explode(F.sequence("low", F.lit(top))))
    rows = rows.withColumn("over", F.expr("shiftright(node, up - level)")).withColumn("end", F.expr("shiftleft(over + 1, up)"))
    closed = rows.where((F.col("end") > before) & (F.col("end") <= newest))
    return closed.groupBy(*PLUG, "value", F.col("up").alias("level"), F.col("over").alias("node")).agg(F.sum("n").alias("n"))


def left_of(before: int, newest: int, top: int) -> list[tuple[int, int]]:
    """Stored nodes (level, number) that new nodes take in: they part the panes from the start of the largest new node on
    that begins before ``before`` and ends by ``newest``."""
    largest = max((k for k in range(1, top + 1) if before % (1 << k) and ((before >> k) + 1) << k <= newest), default=None)
    if largest is None:
        return []
    start, found = before >> largest << largest, []
    for level in reversed(range(largest)):
        if (before - start) >> level & 1:
            found.append((level, start >> level))
            start += 1 << level
    return found


def windows_of_nodes(nodes: DataFrame, first: int, last: int, width: int, top: int) -> DataFrame:
    """Value counts of the windows that end after pane first - 1, ..., last - 1: plug, window (its end), value, n.

    The windows that a node serves are those that hold it but not its parent: at most 2^level in a row.
    """
    size, start = F.expr("shiftleft(1L, level)"), F.expr("shiftleft(node, level)")
    end, latest, left = start + size, start + width, F.col("node") % 2 == 0
    low = F.when(left | (F.col("level") == top), end).otherwise(F.greatest(end, latest - size + 1))
    high = F.when(left & (F.col("level") < top), F.least(end + size - 1, latest)).otherwise(latest)
    low, high = F.greatest(low, F.lit(first)), F.least(high, F.lit(last))
    served = nodes.where(low <= high).select(*PLUG, "value", "n", F.explode(F.sequence(low, high)).alias("window"))
    return served.groupBy(*PLUG, "window", "value").agg(F.sum("n").alias("n"))


def _holds(low: int, high: int, level: int, parity: int | None) -> bool:
    """Whether a node of the level (with an even or odd number) ends in [low, high]."""
    step = 1 << level
    end = -(-low // step) * step
    if parity is not None and (end // step - 1) % 2 != parity:
        end += step
    return end <= high


def needed(kept: Mapping[int, tuple[int, int]], first: int, last: int, width: int, top: int) -> list[tuple[int, int]]:
    """(batch, level) of the folders with nodes for windows that end from first to last.

    ``kept`` has the panes of each batch as (before, newest). Micro-batches of one pane and one window give at most
    two folders per level.
    """
    found = []
    for batch, (before, newest) in kept.items():
        for level in range(top + 1):
            size = 1 << level
            left = (first - size + 1, last, 0)
            right = (first - width + size, last - width + 2 * size - 1, 1)
            ranges = [(first - width + size, last, None)] if level == top else [left, right]
            if any(_holds(max(low, before + 1), min(high, newest), level, parity) for low, high, parity in ranges):
                found.append((batch, level))
    return found
