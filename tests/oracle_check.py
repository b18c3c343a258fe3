"""Run registered queries beside their SQL and compare, as a script:

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got_columns, got = df.columns, df.collect()
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = canonical(got_columns, got), canonical(want_columns, want)
    if a == b:
        return None
    only_a, only_b = list(set(a) - set(b)), list(set(b) - set(a))
    return (
        f"{len(a)} vs {len(b)} rows; only Spark {len(only_a)}, only SQL {len(only_b)}\n"
        f"   {sorted(got_columns)}\n   spark {sorted(only_a, key=repr)[:3]}\n   sql   {sorted(only_b, key=repr)[:3]}"
    )


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, queries[name], oracles[name], sf_dir)
                note = "equal" if diff is None else f"DIFFERS {diff}"
            else:
                diff, note = None, f"{queries[name](spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001
            diff, note = "error", f"ERROR {str(error)[:700]}"
        bad += diff is not None
        print(f"CHECK {name:26s} {time.time() - start:6.2f}s {note}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
