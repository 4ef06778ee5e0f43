"""Readings from files, Kafka, JDBC and from the events table; batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from plugload.schema import PLUG, READING
from plugload.session import configure, is_folder
from plugload.settings import LOAD, Settings


def with_event_time(df: DataFrame) -> DataFrame:
    """Timestamp column for watermarks and event-time windows."""
    return df.withColumn("ts", F.timestamp_millis("ts_ms"))


def between(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Half-open time range on ts_ms; reaches the scan of Parquet and JDBC sources."""
    if start_ms is not None:
        df = df.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("ts_ms") < end_ms)
    return df


def usable(df: DataFrame) -> DataFrame:
    """Rows that are readings: those with an id and a time. Files of JSON or CSV may hold others."""
    return df.where("id is not null and ts_ms is not null")


def load_only(df: DataFrame, house_limit: int | None = None) -> DataFrame:
    """Load readings. A value that is NaN becomes null: such a reading exists and is counted, but has no value."""
    df = df.where(F.col("property") == LOAD).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return df if house_limit is None else df.where(F.col("house_id") < house_limit)


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return usable(configure(spark).read.format(fmt).schema(READING).options(**options).load(path))


def read_archive(spark: SparkSession, folder: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Readings of a time range from an archive that ``persist_readings`` wrote; only its days are listed and read."""
    schema = StructType([*READING.fields, StructField("day", DateType())])
    rows = configure(spark).read.schema(schema).parquet(folder)
    day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    if start_ms is not None:
        rows = rows.where(F.col("day") >= day(start_ms))
    if end_ms is not None:
        rows = rows.where(F.col("day") <= day(end_ms - 1))
    return between(rows, start_ms, end_ms).drop("day")


def stream_readings(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    reader = configure(spark).readStream.format(fmt).schema(READING).options(**options)
    return with_event_time(usable(reader.load(path)))


def stream_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """JSON readings of a topic; rows that are no reading are dropped. Needs the Kafka connector on the class path."""
    raw = (
        configure(spark).readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    )
    return with_event_time(parse_json(raw))


def parse_json(raw: DataFrame) -> DataFrame:
    reading = F.from_json(F.col("value").cast("string"), READING)
    return usable(raw.select(reading.alias("r")).select("r.*"))


def jdbc_options(
    url: str, table: str, start_ms: int, end_ms: int, partitions: int, properties: dict[str, str] | None = None
) -> dict[str, str]:
    """Options of a JDBC scan split by time into parallel range queries."""
    if end_ms <= start_ms:
        raise ValueError("empty time range")
    return {
        **(properties or {}),
        "url": url,
        "dbtable": table,
        "partitionColumn": "time_stamp",
        "lowerBound": str(start_ms),
        "upperBound": str(end_ms),
        "numPartitions": str(partitions),
    }


def read_jdbc_archive(
    spark: SparkSession, url: str, table: str, start_ms: int, end_ms: int, partitions: int, **properties: str
) -> DataFrame:
    """Archive table (id, time_stamp, value, property, plug_id, household_id, house_id) as readings."""
    options = jdbc_options(url, table, start_ms, end_ms, partitions, properties)
    raw = configure(spark).read.format("jdbc").options(**options).load()
    return between(to_readings(raw.withColumnRenamed("time_stamp", "ts_ms")), start_ms, end_ms)


def jdbc_query_options(
    url: str, query: str, split_by: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1
) -> dict[str, str]:
    """Options of a JDBC query; with a numeric column to split by, it runs as parallel range queries."""
    if split_by is None:
        return {"url": url, "query": query}
    if bounds[1] <= bounds[0]:
        raise ValueError("empty range")
    return {
        "url": url, "dbtable": f"({query}) q", "partitionColumn": split_by, "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]), "numPartitions": str(partitions),
    }


def read_jdbc_query(
    spark: SparkSession, url: str, query: str, split_by: str | None = None, bounds: tuple[int, int] = (0, 0),
    partitions: int = 1, **properties: str,
) -> DataFrame:
    """Rows of a query. Without ``split_by`` the result comes through one task, which suits small results only."""
    options = jdbc_query_options(url, query, split_by, bounds, partitions)
    return spark.read.format("jdbc").options(**properties, **options).load()


def to_readings(df: DataFrame) -> DataFrame:
    """Cast the columns of an external table to the reading schema."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in READING.fields))


def _from_events(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    return events.select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        "value",
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("property"),
        F.floor(user / 45).cast("int").alias("plug_id"),
        (F.floor(user / 15) % 3).cast("int").alias("household_id"),
        (user % 15).cast("int").alias("house_id"),
    )


def readings_from_events(
    spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """The events table seen as readings. A time range is put on the stored column, so the scan can skip row groups."""
    events = configure(spark).read.parquet(f"{sf_dir}/events.parquet")
    bound = lambda ms: F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")
    if start_ms is not None:
        events = events.where(F.col("ts") >= bound(start_ms))
    if end_ms is not None:
        events = events.where(F.col("ts") < bound(end_ms))
    return _from_events(events)


def stream_readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, be it one file or a folder of part files."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(configure(spark).read.parquet(path).schema)
    if is_folder(spark, path):
        events = reader.parquet(path)
    else:
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return with_event_time(_from_events(events))


def slice_rows(readings: DataFrame, s: Settings) -> DataFrame:
    """Load readings as the archive scan selects them, below the house limit if one is set."""
    return load_only(readings, s.house_limit).select("id", "ts_ms", "value", *PLUG)
