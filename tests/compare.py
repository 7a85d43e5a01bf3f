"""Run registered queries next to their SQL: ``python tests/compare.py [--sf 0.01] [names...]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def key(row):
    return tuple((v is not None, "" if v is None else str(round(v, 4) if isinstance(v, float) else v)) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def compare(df, con, sql: str) -> tuple[str, int]:
    """("" or what differs, number of rows); values exact but for the last rounded digit."""
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got)
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}", len(got)
    got.sort(key=key), want.sort(key=key)
    for g, w in zip(got, want):
        for c, a, b in zip(cols, g, w):
            if not same(a, b) or type(a) is not type(b):
                return f"{c}: {a!r} vs {b!r} in {g} / {w}", len(got)
    exact = sum(g != w for g, w in zip(got, want))
    return ("" if not exact else f"~ {exact} rows differ in the last digit"), len(got)


def main() -> None:
    import __spark_entry__ as e
    from lexigaze.session import build_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                               "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = e.oracle_sql()
    bad = 0
    for name, f in e.queries().items():
        if a.names and name not in a.names:
            continue
        start = time.time()
        try:
            if name in sql:
                problem, n = compare(f(spark, folder), con, sql[name])
            else:
                problem, n = "(no SQL)", len(f(spark, folder).collect())
        except Exception as err:  # noqa: BLE001
            problem, n = f"ERROR {type(err).__name__} {str(err)[:600]}", -1
        bad += bool(problem) and problem != "(no SQL)"
        print(f"{name:28s} {n:8d} {time.time() - start:6.2f}s {problem}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
