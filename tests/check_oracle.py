"""Compare registered queries with their SQL on one data folder: ``python tests/check_oracle.py [prefix ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def key(row):
    return tuple((x is not None, str(type(x).__name__ in ("int", "float")), x if not isinstance(x, float) else x) if not isinstance(x, (int, float, bool)) or x is None
                 else (True, "n", float(x)) for x in row)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    rows = cur.fetchall()
    pos = [names.index(c) for c in cols]
    want = [tuple(norm(r[p]) for p in pos) for r in rows]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    try:
        got.sort(key=key); want.sort(key=key)
    except TypeError:
        got.sort(key=str); want.sort(key=str)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ on {cols}: spark {bad[0][0]} sql {bad[0][1]}"
    types = [(c, type(a).__name__, type(b).__name__) for g, w in zip(got[:50], want[:50])
             for c, a, b in zip(cols, g, w) if a is not None and b is not None and type(a) is not type(b)]
    if types:
        return f"types {sorted(set(types))}"
    return f"empty" if not got else None


def main(argv):
    from pyspark.sql import SparkSession
    import tempfile
    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            if name in sqls:
                res = compare(fn(spark, sf), con, sqls[name])
            else:
                res = None if fn(spark, sf).count() else "empty"
        except Exception as e:  # noqa: BLE001
            res = f"{type(e).__name__}: {str(e)[:700]}"
        dt = time.time() - t
        if res:
            bad += 1
            print(f"FAIL {name} ({dt:.1f}s) {res[:900]}", flush=True)
        elif dt > 4 or os.environ.get("V"):
            print(f"ok {name} ({dt:.1f}s){'' if name in sqls else ' rows only'}", flush=True)
    print(f"failed {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
