"""Runs queries next to their SQL twins: python tests/compare.py [folder] [names...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, folder):
    """None when equal, else a short description."""
    df = query(spark, folder)
    spark_columns, spark_rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if spark_rows else "no rows"
    result = con.execute(sql)
    duck_columns, duck_rows = canonical([d[0] for d in result.description], result.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} / {duck_columns}"
    if not spark_rows:
        return "no rows"
    if spark_rows != duck_rows:
        only_spark = [r for r in spark_rows[:100000] if r not in set(duck_rows)][:2]
        only_duck = [r for r in duck_rows[:100000] if r not in set(spark_rows)][:2]
        return f"rows {len(spark_rows)} / {len(duck_rows)}: {only_spark} / {only_duck}"
    return None


def main(folder, names):
    import __spark_entry__ as entry
    from levelmark.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        mark = "ok " if problem is None and name in oracles else ("ran" if problem is None else "BAD")
        print(f"{mark} {name:24s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names or queries)} queries, {len(oracles)} with SQL, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])
