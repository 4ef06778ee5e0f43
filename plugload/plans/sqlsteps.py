"""Several SQL statements as one step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def run_statements(spark: SparkSession, views: Mapping[str, DataFrame], statements: Sequence[str]) -> DataFrame:
    """Register the inputs as temporary views, run all statements in order, return the result of the last one.

    The session's own views are as before afterwards; the result does not depend on them.
    """
    if not statements:
        raise ValueError("no statement given")
    catalog = spark.catalog
    own = lambda: {t.name for t in catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in own()}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return [spark.sql(statement) for statement in statements][-1]
    finally:
        for name in own():
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                catalog.dropTempView(name)
