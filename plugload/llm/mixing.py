"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plugload.llm.common import word_count, words
from plugload.session import materialized

#: Rows of a source are dealt into so many hash buckets; only one of them is sorted.
BUCKETS = 4096


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. ``share`` times all sizes is dealt out in
    proportion to the weights. A target that exceeds ``max_epochs`` times its source is clamped there and the
    excess goes to the others in proportion, until none exceeds. If all are clamped the rest stays undealt.
    Each round reads one row of sums; a source of size zero gets the target zero.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weighted = materialized(ranked.select(
        "source", "source_size", F.get(cycle, F.col("rank") % len(weights)).alias("weight"),
        (F.col("source_size") * float(max_epochs)).alias("most"),
    ))
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:
        full = F.col("most") <= level * F.col("weight")
        n, taken, left = weighted.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == clamped or not left:
            break
        clamped, level = n, (total - (taken or 0.0)) / left
    target = F.when(full, F.col("most")).otherwise(level * F.col("weight"))
    return weighted.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of docs: row (struct of the ``carry`` columns), size, source_size, target, whole, part, taken.

    A document is taken ``whole`` times, and once more for its first ``part`` words. All documents of a source are
    taken floor(target / source_size) times. What then lacks is filled with documents in a seeded hash order, each
    taken completely, until the target is met; only the document on the border is taken in part. So the words taken
    equal the target, rounded, for each source.

    Documents are dealt into hash buckets, and the sums of the buckets tell which one holds the border; only its
    rows are sorted, so a source with a third of all rows is no burden. The seeded order depends on id and text, then
    on the carried columns, so reruns agree at any partitioning: rows that tie are equal. Null texts have size 0, null sources form a source of their own, repeated rows
    count each, an empty table gives an empty result. Other columns, whatever their names, are only carried.
    """
    carried = F.struct(*(F.col(c) for c in (carry or docs.columns)))
    order = F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed))
    rows = docs.select(
        carried.alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("order"),
        F.pmod(F.shiftright(order, 20), F.lit(BUCKETS)).alias("bucket"),
    )
    if text not in (carry or docs.columns):
        rows = materialized(rows)
    sums = materialized(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    sizes = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("lack", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # The border bucket is the first whose running sum passes what lacks.
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("upto", F.sum("n").over(upto))
    same = F.col("t.source").eqNullSafe(F.col("r.source"))
    border = targets.alias("t").join(running.alias("r"), same & (F.col("upto") > F.col("lack"))).groupBy("t.source").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("border")
    ).select(F.col("source").alias("of"), "border")
    plan = materialized(
        targets.join(border, F.col("source").eqNullSafe(F.col("of")), "left").select(
            F.col("source").alias("of"), "source_size", "target", "whole", "lack",
            F.coalesce("border.bucket", F.lit(BUCKETS)).alias("at"), F.coalesce("border.before", F.lit(0)).alias("before"),
        )
    )
    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    clear = planned.where("bucket <> at").withColumn("part", F.when(F.col("bucket") < F.col("at"), F.col("size")).otherwise(0))
    tie = F.xxhash64(F.to_json("row"))
    earlier = Window.partitionBy("source").orderBy("order", "size", tie).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    mixed = planned.where("bucket = at").withColumn("start", start).withColumn(
        "part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("lack") - F.col("start")))
    )
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")
    out = ["row", "size", "source_size", "target", "whole", F.col("part").cast("long").alias("part"), taken]
    return clear.select(*out).union(mixed.select(*out))


def repeated(mixed: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The mixed documents themselves, one row per copy, with the columns carried by ``mix``.

    The partial copy of a source's border document holds its first words, joined by single spaces; ``length`` is
    then its number of code points. A document taken completely once more is a whole copy.
    """
    head = F.array_join(F.slice(words(F.col(f"row.{text}")), F.lit(1), F.col("part").cast("int")), " ")
    whole = F.col("whole") + F.when((F.col("part") > 0) & (F.col("part") == F.col("size")), 1).otherwise(0)
    copies = mixed.where(whole > 0).select("row", F.explode(F.array_repeat(F.lit(0), whole.cast("int")))).select("row.*")
    cut = mixed.where((F.col("part") > 0) & (F.col("part") < F.col("size"))).select("row.*", head.alias("_head"))
    names = mixed.schema["row"].dataType.names
    new = {text: F.col("_head"), length: F.length("_head").cast("long")}
    return copies.union(cut.select(*(new[c].alias(c) if c in new else F.col(c) for c in names)))
