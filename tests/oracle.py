"""Runs a registered query and its SQL oracle over the same tables and compares every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> tuple[bool, str]:
    rel = con.execute(sql)
    sql_columns = [c[0] for c in rel.description]
    sql_types = {c[0]: str(c[1]).lower() for c in rel.description}
    expected = _rows(sql_columns, rel.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(sql_columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    if len(got) != len(expected):
        return False, f"rows {len(got)} != {len(expected)}; e.g. {got[:2]} vs {expected[:2]}"
    for a, b in zip(got, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return False, f"{sorted(df.columns)}\n   spark {a}\n   sql   {b}"
    kinds = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    odd = {c: (t, sql_types[c]) for c, t in df.dtypes if kinds.get(t) != sql_types[c] and len(got)}
    return True, f"{len(got)} rows" + (f" TYPES {odd}" if odd else "")


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from bestofk.session import build_session

    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            ok, note = compare(df, oracles[name], con) if name in oracles else (True, f"rows only: {len(df.collect())}")
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24} {time.time() - start:6.2f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
