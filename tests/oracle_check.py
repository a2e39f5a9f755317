"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
(row count, column names, order-insensitive values).  Usage:

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(found):
    names, values = found
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    recs = [tuple(_norm(r[i]) for i in at) for r in values]
    return cols, sorted(recs, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            sp = df.columns, [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:300])
            print(name, "SPARK_ERROR", str(e)[:300], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows_only", len(sp[1]))
            print(f"{name:34s} rows-only {len(sp[1]):8d} rows  spark {ts:6.2f}s", flush=True)
            continue
        t0 = time.time()
        try:
            rel = con.sql(sqls[name])
            dk = rel.columns, rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", str(e)[:300])
            print(name, "SQL_ERROR", str(e)[:400], flush=True)
            continue
        td = time.time() - t0
        sc, sr = rows_of(sp)
        dc, dr = rows_of(dk)
        ok = sc == dc and sr == dr
        status = "OK" if ok else "MISMATCH"
        results[name] = (status, len(sp[1]), len(dk[1]))
        print(f"{name:34s} {status:8s} spark {len(sp[1]):8d} rows {ts:6.2f}s  duck {len(dk[1]):8d} rows {td:6.2f}s",
              flush=True)
        if not ok and verbose:
            if sc != dc:
                print("   columns", sc, dc)
            else:
                diff_s = [r for r in sr if r not in set(dr)][:3]
                diff_d = [r for r in dr if r not in set(sr)][:3]
                print("   spark-only", diff_s)
                print("   duck-only ", diff_d)
    return results


if __name__ == "__main__":
    from seqorbit.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows_only")]
    print("FAILED:", bad if bad else "none")
