"""Command line: ``python -m presslake list`` or ``python -m presslake run QUERY DATA_FOLDER OUT_FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from presslake.plans import registry


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="presslake")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("query", choices=sorted(registry.QUERIES))
    run.add_argument("data")
    run.add_argument("out")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = SparkSession.builder.appName(f"presslake-{args.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    registry.QUERIES[args.query](spark, args.data).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
