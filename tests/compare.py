"""Run queries next to their SQL twins: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def make_spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("parlance-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):  # one machine: any folder is shared
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='parlance-tests-')}")
    return spark


def make_duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def type_differences(frame, cursor) -> str | None:
    spark_types = dict(frame.dtypes)
    wrong = [
        f"{name}: spark {spark_types.get(name)} sql {kind}"
        for name, kind in ((c[0], str(c[1])) for c in cursor.description)
        if KINDS.get(kind, kind) != spark_types.get(name)
    ]
    return "; ".join(wrong) or None


def run_pair(spark, con, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    spark_cols, spark_rows = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return (spark_cols, spark_rows), None
    cursor = con.execute(sql)
    types = type_differences(frame, cursor)
    if types and os.environ.get("SHOW_TYPES"):
        print("  types:", types)
    names = [c[0] for c in cursor.description]
    return (spark_cols, spark_rows), canonical(names, cursor.fetchall())


def explain_difference(left, right) -> str | None:
    if right is None:
        return None
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        message = f"rows {len(left[1])} != {len(right[1])}"
    else:
        message = "values"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{message}: spark {a!r} sql {b!r}"
    return None if len(left[1]) == len(right[1]) else message


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    from parlance.plans.catalog import QUERIES, SQL

    names = argv[1:] or list(QUERIES)
    spark, con = make_spark(), make_duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            left, right = run_pair(spark, con, sf_dir, QUERIES[name], SQL.get(name))
            difference = explain_difference(left, right)
        except Exception as err:  # report and go on with the next query
            difference, left, right = "ERROR " + str(err)[:1500], ((), ()), None
        bad += difference is not None
        verdict = "ok" if difference is None else "BAD"
        kind = "rows" if name not in SQL else "sql"
        print(f"{verdict:4}{kind:5}{name:28}{len(left[1]):8} rows {time.time() - start:6.2f}s {difference or ''}"[:1800], flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
