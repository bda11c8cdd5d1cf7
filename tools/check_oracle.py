"""Compare registered queries with their oracles: python tools/check_oracle.py [sf] [name ...]."""

import sys
from pathlib import Path
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from slotweave.plans.registry import catalogue
from slotweave.plans.views import TABLES
from slotweave.session import local_session


def canon(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = []
    for r in pdf[cols].itertuples(index=False):
        rows.append(tuple(None if v is None or (isinstance(v, float) and v != v) else (repr(float(v)) if isinstance(v, float) else str(v)) for v in r))
    return sorted(rows, key=lambda r: tuple((x is None, x or "") for x in r))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8, 8, app="check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, q in catalogue().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = q(spark, folder)
            got = df.toPandas()
            took = time.time() - start
            if q.sql is None:
                print(f"ROWS {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            t0 = time.time()
            rel = con.sql(q.sql)
            cols, rows = rel.columns, rel.fetchall()
            want = pd.DataFrame(rows, columns=cols, dtype=object)
            a, b = canon(got.astype(object)), canon(want)
            ok = sorted(got.columns) == sorted(want.columns) and a == b
            print(f"{'OK  ' if ok else 'DIFF'} {name}: {len(got)}/{len(want)} rows {took:.1f}s (sql {time.time() - t0:.1f}s)", flush=True)
            if not ok:
                bad += 1
                print("   columns", sorted(got.columns), sorted(want.columns))
                sa, sb = set(a), set(b)
                print("   spark only", [x for x in a if x not in sb][:3])
                print("   sql only  ", [x for x in b if x not in sa][:3])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
