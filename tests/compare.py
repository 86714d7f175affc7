"""Compare registered queries with their SQL run by DuckDB.

    python tests/compare.py [--sf 0.01] [name …]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()
KINDS = {"BOOLEAN": "boolean", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textbench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a DuckDB query; empty when nothing."""
    result = con.execute(sql)
    theirs = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    ours = dict(df.dtypes)
    out = []
    if theirs != ours:
        out.append(f"columns {sorted(set(ours.items()) ^ set(theirs.items()))}")
    if set(theirs) != set(ours):
        return out
    a = _rows(df.columns, [tuple(r) for r in df.collect()])
    b = _rows(list(theirs), result.fetchall())
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    for x, y in zip(a, b):
        if x != y:
            out.append(f"first difference\n   {str(x)[:700]}\n   {str(y)[:700]}")
            break
    return out


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--module", default="", help="only queries of modules that start so")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    folder = f"/root/testdata/sf{opts.sf}"
    import __spark_entry__ as entry

    spark, con = session(), connect(folder)
    runs, sqls = entry.queries(), entry.oracle_sql()
    from textbench.plans.registry import _RUN

    chosen = opts.names or [
        n for n in runs if _RUN[n].__module__.rpartition(".")[2].startswith(opts.module)
    ]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = runs[name](spark, folder)
            if name in sqls:
                found = differences(df, con, sqls[name])
                note = "ok" if not found else "DIFFERS"
            else:
                found, note = [], f"{df.count()} rows, no SQL"
        except Exception as problem:
            found, note = [str(problem)[:1500]], "FAILED"
        bad += bool(found)
        print(f"{name:28s} {note:16s} {time.time() - start:6.2f}s", *found, sep="\n   ", flush=True)
    print(f"{bad} of {len(chosen)} differ or fail")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
