"""Run registered queries on Spark and their SQL oracle on DuckDB and compare.

Comparison: same column names, same row count, same multiset of rows where
every value is rendered canonically (floats by repr, so values must be equal
to the last bit).  Usable from pytest and as a script:

    python -m tests.oracle_harness /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


SPARK_TYPES = {"int": "INT32", "bigint": "INT64", "double": "DOUBLE", "string": "STRING", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOL", "smallint": "INT16", "float": "FLOAT"}
DUCK_TYPES = {"INTEGER": "INT32", "BIGINT": "INT64", "DOUBLE": "DOUBLE", "VARCHAR": "STRING", "DATE": "DATE",
              "TIMESTAMP": "TIMESTAMP", "BOOLEAN": "BOOL", "SMALLINT": "INT16", "FLOAT": "FLOAT"}


def rows_of(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, builder, sql: str | None, con=None, verbose=True) -> dict:
    t0 = time.time()
    sdf = builder(spark, sf_dir)
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"query": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_names = list(rel.columns)
    d_types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(d_names, rel.types)}
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_names) != sorted(d_names):
        res["status"] = f"COLUMNS differ: spark={sorted(s_names)} oracle={sorted(d_names)}"
        return res
    s_types = {c: SPARK_TYPES.get(t, t) for c, t in sdf.dtypes}
    bad_types = {c: (s_types[c], d_types[c]) for c in s_names if s_types[c] != d_types[c]}
    if bad_types:
        res["status"] = f"TYPES differ: {bad_types}"
        return res
    a, b = rows_of(s_names, s_rows), rows_of(d_names, d_rows)
    if a == b:
        res["status"] = "match"
    else:
        sa, sb = set(a), set(b)
        only_s = sorted(sa - sb)[:3]
        only_d = sorted(sb - sa)[:3]
        res["status"] = "VALUES differ"
        res["cols"] = sorted(s_names)
        res["only_spark"] = only_s
        res["only_oracle"] = only_d
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tillroll.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = get_session("local[8]", 8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if wanted and name not in wanted:
            continue
        try:
            r = compare(spark, sf_dir, name, fn, sqls.get(name), con)
        except Exception as e:  # noqa: BLE001
            r = {"query": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} failing", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
