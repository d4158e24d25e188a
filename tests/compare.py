"""Holds queries against their DuckDB SQL on one table set."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return float(round(x, 6)) if type(x).__name__ == "Decimal" else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return sorted(found.columns), rows_of(found.columns, found.fetchall())


def compare(spark, query, sql, sf_dir):
    """None if they agree, else what differs."""
    df = query(spark, sf_dir)
    names, want = oracle_rows(sql, sf_dir)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    got = rows_of(df.columns, df.collect())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracle:
        try:
            print(name, compare(spark, queries[name], oracle[name], sys.argv[1]) or "agrees", flush=True)
        except Exception as e:
            print(name, "FAILED", str(e)[:500].replace("\n", " "), flush=True)
