"""Compare registered Spark queries with their DuckDB oracle SQL.

``python -m acadia.plans.check /root/testdata/sf0.01 [name ...]`` runs both engines on
the same parquet tables and reports, per query, row count, column names and an
order-insensitive comparison of the values, plus equal column types.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
                  "double": "DOUBLE", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def _type_diffs(sdf, rel) -> list:
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in sdf.schema.fields:
        t = f.dataType.simpleString()
        want = _SPARK_TO_DUCK.get(t, t.upper())
        if duck_types.get(f.name) != want:
            out.append((f.name, t, duck_types.get(f.name)))
    return out


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from . import ORACLE, QUERIES
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE:
        res["status"] = "rows-only"
        return res
    rel = con.sql(ORACLE[name])
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return res
    types = _type_diffs(sdf, rel)
    if types:
        res["status"] = f"TYPES {types}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a == b:
        res["status"] = "ok"
    else:
        diff_a = [x for x in a if x not in set(b)][:3]
        diff_b = [x for x in b if x not in set(a)][:3]
        res["status"] = f"VALUES spark-only={diff_a} duck-only={diff_b}"
    return res


def main(argv=None):
    argv = list(sys.argv[1:] if argv is None else argv)
    sf_dir = argv.pop(0) if argv else "/root/testdata/sf0.01"
    from ..session import build_session
    from . import QUERIES
    spark = build_session()
    con = duck(sf_dir)
    names = argv or sorted(QUERIES)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("ok", "rows-only")
        bad += not ok
        print(("  " if ok else "!!"), r, flush=True)
    print(f"{len(names) - bad}/{len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
