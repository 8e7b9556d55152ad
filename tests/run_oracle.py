"""CLI: run registered queries against their DuckDB twins.

    python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from oracle_check import compare, duck
    from kestrel.session import build_session
    spark = build_session()
    con = duck(sf)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        t = time.time()
        try:
            sp = qs[name](spark, sf).toPandas()
            ts = time.time() - t
            if name not in sql:
                print(f"{name:24s} ROWS-ONLY rows={len(sp)} {ts:.1f}s", flush=True)
                continue
            dk = con.execute(sql[name]).df()
            ok, msg = compare(sp, dk)
            bad += not ok
            print(f"{name:24s} {'OK ' if ok else 'BAD'} {msg} {ts:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:24s} ERR {type(e).__name__}: {str(e)[:400]}", flush=True)
            traceback.print_exc(limit=3)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
