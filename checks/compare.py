"""Run every registered query next to its SQL and compare all values.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLES, QUERIES
from gridpulse.session import configure


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(values, key=repr)


def differences(
    spark, connection, sf_dir: str, name: str, queries=QUERIES, oracles=ORACLES
) -> str | None:
    """None when Spark and SQL agree in columns, row count and every value."""
    df = queries[name](spark, sf_dir)
    rows = [tuple(row) for row in df.collect()]
    names, got = _table(df.columns, rows)
    if name not in oracles:
        return "no SQL to compare with"
    result = connection.execute(oracles[name])
    oracle_names, expected = _table([c[0] for c in result.description], result.fetchall())
    if names != oracle_names:
        return f"columns {names} vs {oracle_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}"
    wrong = [(a, b) for a, b in zip(got, expected) if repr(a) != repr(b)]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    return None if rows else "no rows"


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        view = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    return connection


def main() -> int:
    sf_dir, chosen = sys.argv[1], sys.argv[2:] or list(QUERIES)
    builder = configure(SparkSession.builder.master("local[8]").appName("compare"))
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            problem = differences(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}",
              flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
