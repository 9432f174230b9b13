"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, sf_dir: str, name: str, text: str | None = None) -> tuple[bool, str]:
    """Whether a query's rows equal those of its SQL (or of ``text``), and a note."""
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    t1 = time.time()
    text = text or entry.oracle_sql().get(name)
    if text is None:
        return True, f"{len(ours)} rows, no SQL, {t1 - t0:.1f}s"
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return False, f"columns {columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=_key)
    t2 = time.time()
    note = f"{len(ours)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return False, (f"{note}; {len(theirs)} expected; only ours {sorted(a - b, key=_key)[:3]} of {len(a - b)}; "
                       f"only theirs {sorted(b - a, key=_key)[:3]} of {len(b - a)}")
    return True, note


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession
    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name in argv[1:] or list(entry.queries()):
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
