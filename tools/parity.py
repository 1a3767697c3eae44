"""CLI: python tools/parity.py [sf_dir] [name ...] — Spark job vs DuckDB twin."""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from valuescope import catalog  # noqa: E402
from valuescope.parity import compare, duck_connect  # noqa: E402
from valuescope.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    reg = catalog.load_all()
    spark = build_session()
    con = duck_connect(sf_dir)
    bad = 0
    for name, e in reg.items():
        if names and name not in names and e.family not in names:
            continue
        try:
            r = compare(spark, con, name, e.fn, e.sql, sf_dir)
        except Exception as ex:  # report and continue
            r = {"name": name, "status": "error", "detail": repr(ex)[:800]}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(json.dumps(r), flush=True)
    print(json.dumps({"bad": bad}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
