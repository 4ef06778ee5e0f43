from collections import Counter

from pyspark.sql import functions as F

from plugload import Settings
from plugload.operators.blocks import running

BLOCKS = Settings(window_rows=2, block_rows=4)


def test_null_keys_run_on_from_block_to_block(spark):
    rows = [(k, j, i, float(i % 7)) for i in range(60) for k, j in ((None, 1), (None, None), (1, None), (1, 1))]
    df = spark.createDataFrame(rows, "k int, j int, i int, v double").repartition(3)
    args = ["k", "j"], ["i"]
    more = dict(sums={"n": F.lit(1), "total": F.col("v")}, previous={"before": F.col("v")})
    plain, blocks = (running(df, *args, s, **more).collect() for s in (Settings(), BLOCKS))
    assert Counter(plain) == Counter(blocks) and max(r["n"] for r in blocks) == 60
