"""CLI: run every registered query against its DuckDB oracle.

    python tests/run_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from playlens.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    keys = [k for k in keys or qs if k in sqls]
    for k in keys:
        t = time.time()
        try:
            res, _ = compare(qs[k](spark, sf_dir), con, sqls[k])
        except Exception as e:  # noqa: BLE001
            res = {"ok": False, "error": str(e).splitlines()[0][:300]}
        bad += not res["ok"]
        print(f"{'OK ' if res['ok'] else 'BAD'} {k:28s} {time.time() - t:6.2f}s {res}", flush=True)
    print(f"{len(keys) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main()
