"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python -m tests.compare SF_DIR [QUERY …]
"""

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    """Rows as sorted text, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "∅"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    """What differs, or None when both sides hold the same rows."""
    left = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.execute(sql)
    right = canonical([d[0] for d in found.description], found.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} / {len(right[1])}"
    only = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(only)} rows differ, first: {only[0]}" if only else None


def main(sf_dir, *names):
    from sightline.plans.catalog import QUERIES
    from sightline.plans.oracle import oracle_queries
    from tests.conftest import session

    spark, con, sqls, bad = session(), duck(sf_dir), oracle_queries(), 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            verdict = difference(fn(spark, sf_dir), con, sqls[name]) if name in sqls else "no SQL"
        except Exception as exc:
            verdict = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += verdict is not None
        print(f"{name:24s} {time.time() - start:6.2f}s  {'ok' if verdict is None else 'DIFF ' + verdict[:900]}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
