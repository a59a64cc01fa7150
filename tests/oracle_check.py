"""Run registered queries next to their SQL in DuckDB and compare every value.

Usage: python tests/oracle_check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    return sorted([tuple(None if isinstance(r[i], float) and r[i] != r[i] else r[i] for i in order) for r in rows], key=key)


def compare(spark, con, fn, sql, sf_dir):
    """(ok, message)"""
    df = fn(spark, sf_dir)
    got = _norm([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = _norm(cur.fetchall(), want_cols)
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {df.columns} vs {want_cols}"
    if not want:
        return False, f"empty: spark {len(got)} rows, sql 0"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}: {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)}/{len(got)} rows differ, e.g. {sorted(df.columns)} {bad[0][0]} vs {bad[0][1]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as e
    from tidepanel.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "12g", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles, fails = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                ok, msg = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                ok, msg = n > 0, f"{n} rows (no SQL)"
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
        if not ok:
            fails.append(name)
    print("failed:", fails)
