"""Run registered queries and their SQL side by side: `python tests/compare.py 0.01 [names]`."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from bidloom.session import spark_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, d, name, sql):
    df = entry.queries()[name](spark, d)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    theirs = rows_of(relation.columns, relation.fetchall())
    problems = []
    if sorted(df.columns) != sorted(relation.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(relation.columns)}")
    types = dict(df.dtypes)
    for column, kind in zip(relation.columns, relation.types):
        if TYPES.get(str(kind), str(kind)) != types.get(column):
            problems.append(f"type of {column}: {types.get(column)} != {kind}")
    if mine != theirs:
        missing, extra = set(theirs) - set(mine), set(mine) - set(theirs)
        problems.append(f"rows {len(mine)} vs {len(theirs)}; only sql {sorted(missing)[:2]} only spark {sorted(extra)[:2]}")
    return len(mine), problems


def main():
    d = f"/root/testdata/sf{sys.argv[1]}"
    spark = spark_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    oracle = entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or list(oracle):
        started = time.time()
        try:
            n, problems = compare(spark, con, d, name, oracle[name])
        except Exception as error:  # noqa: BLE001 - a report, not control flow
            n, problems = 0, [str(error)[:700]]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name:26s} {n:7d} rows {time.time() - started:5.1f}s {' | '.join(problems)}", flush=True)
    print(f"{bad} differ; without SQL: {sorted(set(entry.queries()) - set(oracle))}")


if __name__ == "__main__":
    main()
