"""Command line: run the bronze -> silver -> gold job on a raw file.

    python -m shiprisk medallion --raw 'landing/*.csv' --root /shared/supply \\
        [--cutoff 2017-11-01] [--master local[*]]

On a cluster, submit with spark-submit and leave --master out; the session
settings (AQE, ANSI, UTC) are applied on top of the cluster's own.
"""

from __future__ import annotations

import argparse
import sys

from shiprisk import config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shiprisk")
    sub = parser.add_subparsers(dest="command", required=True)
    med = sub.add_parser("medallion", help="raw CSV -> bronze -> silver -> gold tables")
    med.add_argument("--raw", required=True, help="raw order-line CSV file(s) or folder")
    med.add_argument("--root", required=True, help="shared folder for the versioned tables")
    med.add_argument("--cutoff", default=config.DATA_CUTOFF, help="revenue cutoff (exclusive)")
    med.add_argument("--master", default=None, help="Spark master for local runs")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from shiprisk.plans.medallion import run_medallion
    from shiprisk.session import apply_defaults, build_session

    spark = build_session(args.master) if args.master else SparkSession.builder.getOrCreate()
    apply_defaults(spark)
    summary = run_medallion(spark, args.raw, args.root, args.cutoff)
    for row in summary.orderBy("table_name").collect():  # one row per written table
        print(f"{row.table_name:35s} v{row.version:<3d} {row.n_rows:>14,d} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
