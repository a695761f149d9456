"""Compare every query with its SQL on one scale factor: python tests/check_sql.py [sf] [query ...]"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    """Rows as sorted tuples of text, columns in name order."""
    places = [columns.index(c) for c in sorted(columns)]

    def shown(v):
        return "" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(shown(r[i]) for i in places) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str:
    got = fn(spark, sf_dir)
    rows = got.collect()
    if sql is None:
        return f"rows={len(rows)} (no SQL)"
    types = {c: SQL_TYPES.get(t, t) for c, t in got.dtypes}
    sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != sql_types:
        return f"MISMATCH types {types} / {sql_types}"
    want = con.execute(sql).fetchall()
    a, b = rows_of(got.columns, rows), rows_of(list(sql_types), want)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"MISMATCH rows {len(a)} / {len(b)}\n  spark only {str(only_a)[:600]}\n  sql only   {str(only_b)[:600]}"
    return f"ok rows={len(a)} {hashlib.md5(repr(a).encode()).hexdigest()[:8]}"


if __name__ == "__main__":
    import __spark_entry__ as contract
    from lumisift.session import session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = session(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                       "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), contract.oracle_sql()
    names = sys.argv[2:] or list(contract.queries())
    failed = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name, contract.queries()[name], sql.get(name))
        except Exception as e:
            result = f"MISMATCH {type(e).__name__}: {str(e)[:800]}"
        failed += "MISMATCH" in result
        print(f"{name}: {result} {time.time() - start:.1f}s", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
