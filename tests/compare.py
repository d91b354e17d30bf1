"""Run registered queries next to their SQL counterparts.

    python tests/compare.py [folder] [name …]
"""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("caseweave")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: repr(v) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(fix(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql) -> str:
    df = fn(spark, folder)
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if any(t.startswith(("array", "map", "struct")) for t in types.values()):
        return f"nested columns {types}"
    if sql is None:
        return f"rows only: {len(left)}"
    result = con.execute(sql)
    right_types = {d[0]: str(d[1]) for d in result.description}
    right_cols, right = rows_of([d[0] for d in result.description], result.fetchall())
    if left_cols != right_cols:
        return f"COLUMNS {left_cols} != {right_cols}"
    if left != right:
        only_left = [x for x in left[:200000] if x not in set(right)][:3]
        only_right = [x for x in right[:200000] if x not in set(left)][:3]
        return f"VALUES {len(left)} vs {len(right)}; only spark {only_left}; only sql {only_right}"
    odd = [f"{c}:{types[c]}/{right_types[c]}" for c in left_cols
           if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
               "boolean": "BOOLEAN"}.get(types[c]) != right_types[c]]
    return f"ok {len(left)} rows" + (f"  TYPES {odd}" if odd else "")


def main() -> None:
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [n for n in queries if not args[1:] or any(n.startswith(a) for a in args[1:])]
    spark, con = session(int(os.environ.get("CPUS", "8"))), duck(folder)
    for name in picked:
        start = time.time()
        try:
            verdict = compare(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as error:  # report and go on
            verdict = f"ERROR {type(error).__name__} {" ".join(str(error).split())[:300]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
