"""Runs registered queries against their SQL in DuckDB. Usage: compare.py SF_DIR [query…]"""

from __future__ import annotations

import sys
import time
import traceback
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    """Type-strict text of a cell, so that 1 and 1.0 or DECIMALs of another scale differ."""
    if isinstance(value, Decimal):
        return f"D{value}"
    if isinstance(value, float):
        return f"f{value + 0.0!r}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def mismatch(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        return f"rows {sum(got.values())} vs {sum(want.values())}; spark-only {list((got - want).items())[:2]}; sql-only {list((want - got).items())[:2]}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from ledgerloom.session import configure

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = (
        configure(SparkSession.builder.master("local[8]"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = mismatch(spark, con, query, sqls[name], sf_dir) if name in sqls else f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if only:
                traceback.print_exc()
        bad += bool(problem) and name in sqls
        print(f"{'ok  ' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("mismatching:", bad)


if __name__ == "__main__":
    main()
