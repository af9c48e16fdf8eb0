"""Run every registered query and its SQL side by side.

    python tests/check_queries.py /root/testdata/sf0.01 [name …]
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)].copy()
    for c in rows.columns:
        numeric = pd.api.types.is_numeric_dtype(rows[c])
        rows[c] = rows[c].astype("float64").round(6) if numeric else rows[c].astype(object).where(rows[c].notna(), None)
        if not numeric and rows[c].notna().sum() == 0:
            rows[c] = rows[c].astype("float64")
    return rows.sort_values(list(rows.columns), na_position="first").reset_index(drop=True)


def compare(spark, con, sf_dir, name):
    """None if both agree, otherwise what differs."""
    ours = normal(entry.queries()[name](spark, sf_dir).toPandas())
    theirs = normal(con.execute(entry.oracle_sql()[name]).df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} / {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)} rows"
    try:
        pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
    except AssertionError as error:
        return str(error)
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    con = oracle(folder)
    bad = 0
    for name in sys.argv[2:] or entry.oracle_sql():
        start = time.time()
        problem = compare(session, con, folder, name)
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("all agree" if not bad else f"{bad} differ")
