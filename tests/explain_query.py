"""CLI: print the formatted physical plan of registered queries.

    python tests/explain_query.py level_summary [more keys ...] [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from playlens.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf_dir = args[i + 1]
        args = args[:i] + args[i + 2:]
    spark = build_session("local[8]", 8)
    for key in args or ["level_summary"]:
        print(f"===== {key}")
        entry.queries()[key](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
