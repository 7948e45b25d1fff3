"""Runs registered queries and their SQL side by side: python tests/oracle_check.py [sf] [name ...]"""
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or isinstance(v, bool):
        return repr(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(v) < 5e-7 else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def typed(v):
    return "f" if isinstance(v, float) else "b" if isinstance(v, bool) else "i" if isinstance(v, int) else type(v).__name__


def compare(df, con, sql):
    """Problems found, as text; empty when equal."""
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = sorted(tuple(map(canon, r)) for r in got), sorted(tuple(map(canon, r)) for r in want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        sa, sb = set(a), set(b)
        return f"{len(sa - sb)} rows differ of {len(a)}; cols {cols}\n   only spark {sorted(sa - sb)[:2]}\n   only sql   {sorted(sb - sa)[:2]}"[:1800]
    for i, c in enumerate(cols):
        kinds = {typed(r[i]) for r in got if r[i] is not None} | {typed(r[i]) for r in want if r[i] is not None}
        if len(kinds) > 1:
            return f"types of {c}: {kinds}"
    return "" if a else "EMPTY"


def main():
    from pyspark.sql import SparkSession
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    names = [n for n in qs if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in sqls:
                msg = compare(df, con, sqls[n])
            else:
                msg = "" if df.count() else "EMPTY"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {n} {time.time() - t:.1f}s {'' if n in sqls else '(rows only)'} {msg}", flush=True)
    print(f"{len(names)} queries, {bad} with problems")


if __name__ == "__main__":
    main()
