"""Sinks for readings and results, with row metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from plugload.functions.columns import latency_ms
from plugload.operators.blocks import sample_every_n
from plugload.settings import Settings

# Column names of the relational archive table.
ARCHIVE_COLUMNS = ["id", "time_stamp", "value", "property", "plug_id", "household_id", "house_id"]


def with_day_folder(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))


def persist_readings(
    stream: DataFrame, folder: str, state: str, available_now: bool = False, trigger: str = "1 minute"
) -> StreamingQuery:
    """Append live readings to the Parquet archive, one folder per day; ``read_archive`` reads a range of days.

    The file sink commits each micro-batch once; a restart from ``state`` neither loses nor repeats rows.
    """
    when = {"availableNow": True} if available_now else {"processingTime": trigger}
    return (
        with_day_folder(stream.drop("ts")).writeStream.format("parquet").partitionBy("day")
        .option("path", folder).option("checkpointLocation", state).trigger(**when).start()
    )


def jdbc_writer(
    url: str, table: str, s: Settings, staged: bool = True, **properties: str
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that writes readings to the relational archive in batches of jdbc_batch_rows.

    Each micro-batch has a table of its own, ``<table>_<batch id>``, which a retry overwrites, so no row is stored
    twice; a view over them or a scheduled insert gives the archive. With ``staged=False`` rows are appended to the
    archive at once and a retried micro-batch repeats its rows.
    """
    options = {**properties, "batchsize": str(s.jdbc_batch_rows)}

    def write(batch: DataFrame, batch_id: int) -> None:
        target, mode = (f"{table}_{batch_id}", "overwrite") if staged else (table, "append")
        archive_rows(batch).write.jdbc(url, target, mode=mode, properties=options)

    return write


def archive_rows(readings: DataFrame) -> DataFrame:
    return readings.withColumnRenamed("ts_ms", "time_stamp").select(*ARCHIVE_COLUMNS)


def write_results(
    results: DataFrame, folder: str, state: str, available_now: bool = False, trigger: str = "1 minute"
) -> StreamingQuery:
    """Append a stream of results to Parquet."""
    when = {"availableNow": True} if available_now else {"processingTime": trigger}
    return (
        results.writeStream.format("parquet").outputMode("append").option("path", folder)
        .option("checkpointLocation", state).trigger(**when).start()
    )


def with_latency(results: DataFrame, eval_ms: str = "eval_ms") -> DataFrame:
    """Milliseconds since the evaluation of a result row, taken when the row is delivered."""
    return results.withColumn("latency_ms", latency_ms(F.col(eval_ms)))


def observed(results: DataFrame, name: str, latency: str | None = None) -> DataFrame:
    """Count result rows (and their latency) while they pass, without another job."""
    metrics = [F.count(F.lit(1)).alias("rows")]
    if latency:
        metrics += [F.avg(latency).alias("avg_latency_ms"), F.max(latency).alias("max_latency_ms")]
    return results.observe(name, *metrics)


def observation(results: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same for a batch result; read ``observation.get`` after the action."""
    seen = Observation(name)
    return results.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class ResultMetrics(StreamingQueryListener):
    """Keeps the observed metrics of every micro-batch per query name."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, dict]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = {name: row.asDict() for name, row in progress.observedMetrics.items()}
        self.batches.append((progress.batchId, seen))

    def onQueryTerminated(self, event) -> None:
        pass


def result_log(results: DataFrame, n: int, order: list[str], s: Settings) -> DataFrame:
    """Every n-th result row, numbered, for logging."""
    return sample_every_n(results, n, order, s)
