"""The one record type of the engine and its key columns."""

from pyspark.sql import types as T

READING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("property", T.IntegerType()),
        T.StructField("plug_id", T.IntegerType()),
        T.StructField("household_id", T.IntegerType()),
        T.StructField("house_id", T.IntegerType()),
    ]
)

HOUSE = ["house_id"]
PLUG = ["house_id", "household_id", "plug_id"]
