"""Run one registered query from the command line.

    python -m acadia.plans.run <name> <sf_dir> [--out PATH] [--show N] [--explain]

``--out`` writes the result as parquet (a new folder); ``--show`` prints the first rows;
``--explain`` prints the formatted physical plan.  ``--list`` lists the query names.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="acadia.plans.run")
    ap.add_argument("name", nargs="?")
    ap.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("--out")
    ap.add_argument("--show", type=int, default=0)
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("--list", action="store_true")
    args = ap.parse_args(argv)
    from . import QUERIES
    if args.list or not args.name:
        print("\n".join(sorted(QUERIES)))
        return 0
    from ..session import build_session
    spark = build_session()
    df = QUERIES[args.name](spark, args.sf_dir)
    if args.explain:
        df.explain("formatted")
    if args.show:
        df.show(args.show, truncate=False)
    if args.out:
        df.write.mode("errorifexists").parquet(args.out)
        print(f"wrote {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
