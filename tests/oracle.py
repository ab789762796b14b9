"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    return str(value)


_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, name, query, sql, folder):
    """Raises AssertionError on any difference; returns (rows, spark seconds)."""
    begin = time.time()
    df = query(spark, folder)
    rows = df.collect()
    took = time.time() - begin
    if sql is None:
        return len(rows), took
    con = connect(folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    assert sorted(names) == sorted(df.columns), f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    for field in df.schema:
        want = _KINDS.get(field.dataType.simpleString())
        assert want is None or want == kinds[field.name], f"{name}.{field.name}: {want} != {kinds[field.name]}"
    order = sorted(names)
    mine = sorted(tuple(_plain(r[c]) for c in order) for r in rows)
    at = [names.index(c) for c in order]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in expected)
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(mine)][:2]
        raise AssertionError(f"{name}: {len(mine)} rows vs {len(theirs)}; {order}\n  spark {only_mine}\n  sql   {only_theirs}"[:3000])
    return len(rows), took


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from corpusloom.session import local_session

    folder = "/root/testdata/sf" + sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(cores=8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            n, took = compare(spark, name, function, oracles.get(name), folder)
            print(f"{'ok  ' if name in oracles else 'rows'} {name:32s} {n:8d} {took:6.2f}s", flush=True)
        except Exception as e:
            bad += 1
            print(f"BAD  {name}: {type(e).__name__} {str(e)[:1800]}", flush=True)
    print("bad", bad)
