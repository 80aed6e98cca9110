"""Runs registered queries next to their SQL and compares all values.

    python tests/compare.py <folder> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [names[i] for i in order], sorted(picked, key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def mismatch(df, con, sql: str) -> str | None:
    """None if both give the same columns, types and rows."""
    relation = con.sql(sql)
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = canonical(relation.columns, relation.fetchall())
    if names != want_names:
        return f"columns {names} / {want_names}"
    if len(rows) != len(want):
        return f"rows {len(rows)} / {len(want)}"
    bad = [(r, w) for r, w in zip(rows, want) if not all(same(x, y) for x, y in zip(r, w))]
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "HUGEINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean"}
    types = dict(df.dtypes)
    odd = [
        (c, types[c], str(t))
        for c, t in zip(relation.columns, relation.types)
        if kinds.get(str(t)) != types[c]
    ]
    if odd:
        return f"types {odd}"
    return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> int:
    from crashgrade.session import local_session
    import __spark_entry__ as contract

    folder, only = sys.argv[1], sys.argv[2:]
    spark = local_session(8, **{"spark.driver.memory": "8g"})
    con = connect(folder)
    sql = contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                found = mismatch(df, con, sql[name])
            else:
                found = None if df.count() else "no rows"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if found else 'ok  '} {kind} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
