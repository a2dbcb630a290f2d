"""Command line: load a comma-separated file, or generate one.

    python -m quern load FILE [--errors N]
    python -m quern generate {sales,prices} ROWS FOLDER
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from quern.sources.delimited import read_csv
from quern.sources.generate import prices, sales, write_csv


def load(spark: SparkSession, path: str, errors: int) -> None:
    """Print a file's schema, rows, errors and the time taken."""
    began = time.perf_counter()
    table, report = read_csv(spark, path)
    print(f"{report.rows_processed} rows in {time.perf_counter() - began:.3f} s")
    table.df.printSchema()
    report.errors.show(errors, truncate=False)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("load")
    one.add_argument("path")
    one.add_argument("--errors", type=int, default=20, help="errors to show")
    two = commands.add_parser("generate")
    two.add_argument("kind", choices=["sales", "prices"])
    two.add_argument("rows", type=int)
    two.add_argument("folder")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    if given.command == "load":
        load(spark, given.path, given.errors)
    else:
        write_csv({"sales": sales, "prices": prices}[given.kind](spark, given.rows), given.folder)


if __name__ == "__main__":
    main()
