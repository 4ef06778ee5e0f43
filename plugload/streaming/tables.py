"""Versioned tables that a stream keeps between micro-batches, and delivery of its results.

A micro-batch writes each of its tables once, as a folder of its own; a retry finds what is there and does not write it
again, so whoever follows a table sees every row once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from time import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plugload.operators.blocks import row_numbers
from plugload.session import file_times, is_folder, remove, rename, subfolders
from plugload.settings import Settings


class Tables:
    """Folders ``<folder>/<table>/batch-<id>``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/batch-{batch_id}"

    def publish(self, table: str, batch_id: int, rows: DataFrame) -> DataFrame:
        """Write the rows of a batch unless they are there, and read them back.

        The folder gets its name when it is complete; names that begin with an underscore are invisible to readers.
        """
        target = self.path(table, batch_id)
        if not is_folder(self.spark, target):
            stage = f"{self.folder}/{table}/_batch-{batch_id}"
            rows.write.mode("overwrite").parquet(stage)
            rename(self.spark, stage, target)
        return self.read(table, [batch_id], rows.schema)

    def read(self, table: str, batches: Iterable[int], schema: StructType | str) -> DataFrame:
        paths = [p for p in (self.path(table, b) for b in batches) if is_folder(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def batches(self, table: str) -> list[int]:
        names = subfolders(self.spark, f"{self.folder}/{table}")
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))

    def all(self, table: str, schema: StructType | str) -> DataFrame:
        return self.read(table, self.batches(table), schema)

    def follow(self, table: str, schema: StructType | str) -> DataFrame:
        """The table as a stream: every published batch once."""
        reader = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.folder}/{table}")

    def drop(self, table: str, batches: Iterable[int]) -> None:
        for b in batches:
            remove(self.spark, self.path(table, b))


def write_turns(rows: DataFrame, turn: str, folder: str) -> bool:
    """Write rows as files that a stream takes one after the other, in the order of the column ``turn``.

    Rows of a turn must be in one partition, which becomes a file. The file source goes by the times of files, so
    these are set; False if the file system does not keep them, and then the order is not known.
    """
    rows.write.partitionBy(turn).parquet(folder)
    return file_times(rows.sparkSession, folder, lambda path: (int(path.rsplit(f"/{turn}=", 1)[1].split("/")[0]), path))


def follow_turns(spark: SparkSession, folder: str, schema: StructType | str, ordered: bool = True) -> DataFrame:
    """The files of ``write_turns`` as a stream, one file per micro-batch; all files in one if their order is not known."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", 1) if ordered else reader).parquet(folder)


DELIVERED = "batch bigint, rows bigint, upto bigint, avg_latency_ms double, max_latency_ms bigint"


def deliver(
    tables: Tables, batch_id: int, results: DataFrame, since_ms: Column, order: Sequence[str], s: Settings,
    every: int | None = None, table: str = "results",
) -> DataFrame:
    """Publish the results of a batch with their latency, count them, and log every n-th row of the whole stream.

    latency_ms is the time from ``since_ms`` to this delivery. The table ``delivered`` has one row per batch: its rows, the rows
    up to and including it, and latencies; the table ``log`` has the rows numbered every, 2 every, ... along ``order``,
    counted over all batches. The count is read from the version before, so a retry numbers alike.
    """
    now = F.lit(round(time() * 1000))
    rows = tables.publish(table, batch_id, results.withColumn("latency_ms", now - since_ms))
    before = tables.read("delivered", [batch_id - 1], DELIVERED).agg(F.max("upto")).first()[0] or 0
    counted = rows.agg(F.count("*").alias("rows"), F.avg("latency_ms").alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
    tables.publish("delivered", batch_id, counted.select(
        F.lit(batch_id).cast("long").alias("batch"), "rows", (F.col("rows") + before).alias("upto"), "avg_latency_ms", "max_latency_ms"
    ))
    if every:
        numbered = row_numbers(rows, order, s).withColumn("row_no", F.col("row_no") + before)
        tables.publish("log", batch_id, numbered.where(F.col("row_no") % every == 0))
    return rows
