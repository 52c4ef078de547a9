"""Command line: lists the queries, runs one over a folder of tables, or sweeps the re-ranking parameter.

    python -m equirank list
    python -m equirank run parity_per_query --data DIR --out PATH --format csv
    python -m equirank sweep --data DIR --lambdas 0.5,0.7,1.0 --allow-unjudged --out PATH
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import sweep as W
from .plans import catalog
from .plans import tables as B
from .sources import sinks

FORMATS = {"parquet": sinks.write_parquet, "csv": sinks.write_csv, "json": sinks.write_json_lines, "document": sinks.write_document}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="equirank", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("query", choices=sorted(catalog.QUERIES), metavar="QUERY")
    sweep = commands.add_parser("sweep", help="fairness and utility for each value of the re-ranking parameter")
    sweep.add_argument("--lambdas", default=",".join(map(str, B.LAMBDAS)), help="comma-separated values")
    sweep.add_argument("--allow-unjudged", action="store_true", help="utility also where too few hits are judged")
    for command in (run, sweep):
        command.add_argument("--data", required=True, help="folder of the parquet tables")
        command.add_argument("--out", help="where the result goes; without it a table is shown")
        command.add_argument("--format", choices=sorted(FORMATS), default="parquet")
    return out


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "run":
        return catalog.QUERIES[args.query](spark, args.data)
    lambdas = [float(x) for x in args.lambdas.split(",")]
    return W.sweep(B.diverse_run(spark, args.data, lambdas), B.labels(spark, args.data), B.qrels(spark, args.data), allow_untrusted=args.allow_unjudged).orderBy("lam")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = SparkSession.builder.appName("equirank").getOrCreate()
    df = result(spark, args)
    if args.out:
        FORMATS[args.format](df, args.out)
    else:
        sinks.show_table(df)


if __name__ == "__main__":
    main()
