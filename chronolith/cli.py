"""Command line: ``python -m chronolith.cli --prepare-data yttr --source DIR --target DIR``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronolith", description="Temporal analytics on Spark")
    out.add_argument("-p", "--prepare-data", metavar="DATASET", help="yttr: clean one year of taxi trips from Parquet to CSV")
    out.add_argument("--source", help="folder of Parquet files")
    out.add_argument("--target", help="folder for the CSV files")
    out.add_argument("--year", type=int, default=2022)
    out.add_argument("--start", default="tpep_pickup_datetime")
    out.add_argument("--end", default="tpep_dropoff_datetime")
    return out


def main(args: Sequence[str] | None = None) -> int:
    p = parser()
    found = p.parse_args(args)
    if found.prepare_data is None:
        p.print_help()
        return 0
    name = found.prepare_data.lower()
    if name.startswith("lineitem"):
        print("preparing lineitem is not supported")
        return 0
    if not name.startswith("yttr"):
        print(f"unknown data set {found.prepare_data}", file=sys.stderr)
        return 1
    if not found.source or not found.target:
        print("--source and --target are needed", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .sources.clean import prepare

    prepare(SparkSession.builder.getOrCreate(), found.source, found.target, found.start, found.end, found.year)
    return 0


if __name__ == "__main__":
    sys.exit(main())
