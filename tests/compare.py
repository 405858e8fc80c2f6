"""Run named queries next to their SQL twins and report differences.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract
from hallmark.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = [frame[c].tolist() for c in sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns)]
    return sorted(rows, key=repr)


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}"
    kinds = [
        (c, str(spark_frame[c].dtype), str(sql_frame[c].dtype))
        for c in sorted(spark_frame.columns)
        if spark_frame[c].dtype != sql_frame[c].dtype and "float" in
        (str(spark_frame[c].dtype) + str(sql_frame[c].dtype))
    ]
    return f"types {kinds}" if kinds else None


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    sql = contract.oracle_sql()
    queries = contract.queries()
    unknown = set(sql) - set(queries)
    if unknown:
        print("SQL without a query:", sorted(unknown))
    for name in names or queries:
        started = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - started
            note = f"{len(got)} rows"
            if name in sql:
                started = time.time()
                want = con.execute(sql[name]).df()
                note += f", sql {time.time() - started:.1f}s"
                found = difference(got, want)
                note += f"  DIFF {found}" if found else "  ok"
            print(f"{name:28s} {took:6.1f}s {note}", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"{name:28s} FAILED {type(error).__name__} {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
