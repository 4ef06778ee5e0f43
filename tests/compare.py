"""Compare registered queries with their DuckDB counterparts: python tests/compare.py SF_DIR [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def differences(spark_rows: pd.DataFrame, oracle_rows: pd.DataFrame) -> str:
    """Empty text if both hold the same columns and rows."""
    columns = sorted(spark_rows.columns)
    if columns != sorted(oracle_rows.columns):
        return f"columns {columns} / {sorted(oracle_rows.columns)}"
    if len(spark_rows) != len(oracle_rows):
        return f"rows {len(spark_rows)} / {len(oracle_rows)}"
    left, right = ([tuple(map(_plain, r)) for r in df[columns].itertuples(index=False)] for df in (spark_rows, oracle_rows))
    left.sort(key=repr)
    right.sort(key=repr)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def _plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    return float(value) if isinstance(value, float) else (int(value) if hasattr(value, "__int__") and not isinstance(value, str) else value)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.session import local_session

    spark = local_session()
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, oracles = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            rows = df.toPandas()
            took = time.time() - began
            began = time.time()
            oracle = con.execute(oracles[name]).df()
            wrong = differences(rows, oracle)
            types = [(f.name, f.dataType.simpleString()) for f in df.schema]
            print(f"{name:28s} {len(rows):8d} rows {took:6.2f}s (duckdb {time.time() - began:5.2f}s) {wrong or 'ok'}", flush=True)
            if wrong:
                print("   ", types, list(oracle.dtypes.items()), flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:28s} FAILED {str(error)[:600]}", flush=True)
