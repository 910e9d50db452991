"""Spark-vs-DuckDB parity for registered queries, the way the driver compares them.

Columns are sorted by name, rows compared as an order-insensitive multiset.
Run directly: ``python tests/parity.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x, digits) for x in v)
    return v


_SPARK = {"LongType": "int64", "IntegerType": "int32", "ShortType": "int16", "DoubleType": "float64",
          "FloatType": "float32", "StringType": "string", "BooleanType": "bool"}
_DUCK = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "DOUBLE": "float64", "FLOAT": "float32",
         "VARCHAR": "string", "BOOLEAN": "bool", "HUGEINT": "int128"}


def _spark_type(t):
    return _SPARK.get(type(t).__name__, type(t).__name__)


def _duck_type(t):
    return _DUCK.get(t, t)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, sf_dir, digits=None):
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    t0 = time.time()
    s_cols = df.columns
    s_rows = df.collect()
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(o_rows), "spark_s": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(o_cols):
        res["match"] = False
        res["why"] = f"columns {sorted(s_cols)} vs {sorted(o_cols)}"
        return res
    s_types = {f.name: _spark_type(f.dataType) for f in df.schema.fields}
    o_types = {d[0]: _duck_type(str(d[1])) for d in cur.description}
    bad = {c: (s_types[c], o_types[c]) for c in s_cols if s_types[c] != o_types[c]}
    if bad:
        res["type_mismatch"] = bad
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    oi = [o_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i], digits) for i in si) for r in s_rows), key=repr)
    b = sorted((tuple(_norm(r[i], digits) for i in oi) for r in o_rows), key=repr)
    res["match"] = a == b
    if not res["match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [x for x in a if x not in sb][:3]
        res["only_oracle"] = [x for x in b if x not in sa][:3]
    return res


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from dialframe.session import local_session
    import __spark_entry__ as entry
    spark = local_session(shuffle_partitions=8)
    con = duck(sf)
    for n in names or list(entry.queries()):
        try:
            print(compare(spark, con, n, sf), flush=True)
        except Exception as e:  # report and go on
            print({"name": n, "error": repr(e)[:600]}, flush=True)
