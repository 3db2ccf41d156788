"""Run registered queries next to their SQL twins: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not isinstance(x, (list, tuple, dict)) and not hasattr(x, "__len__") and pd.isna(x)):
            return None
        if isinstance(x, (bool,)) or str(type(x)).endswith("bool_'>"):
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return float(x)
        return str(x)

    columns = sorted(df.columns)
    rows = [tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def main() -> None:
    from checks import all_queries

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    wanted = args[1:]
    path = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    spark = session()
    queries, oracles = all_queries()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, path).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"{name:34s} rows-only {len(got):7d} {took:6.1f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(oracles[name]).df()
            sql_took = time.time() - start
            if sorted(got.columns) != sorted(want.columns):
                raise AssertionError(f"columns {sorted(got.columns)} / {sorted(want.columns)}")
            a, b = canonical(got), canonical(want)
            same = a == b
            print(f"{name:34s} {'ok ' if same else 'BAD'} {len(a):7d} {len(b):7d} {took:6.1f}s sql {sql_took:5.1f}s", flush=True)
            if not same:
                bad.append(name)
                sa, sb = set(a), set(b)
                print("   spark:", [str(r)[:300] for r in sorted(sa - sb, key=str)[:2]])
                print("   sql:  ", [str(r)[:300] for r in sorted(sb - sa, key=str)[:2]], sorted(got.columns))
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"{name:34s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
