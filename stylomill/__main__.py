"""Runs a query from the command line: python -m stylomill QUERY --data FOLDER --out PATH.

The parameters of single operators are their functions' keyword arguments."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import catalogue

FORMATS = {"parquet": {}, "json": {}, "csv": {"header": True}, "tsv": {"header": True, "sep": "\t"}}


def parameters() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stylomill", description="Style measures over text corpora.")
    p.add_argument("query", nargs="?", help="its name; without one, all names are listed")
    p.add_argument("--data", default=".", help="folder of the tables, as Parquet")
    p.add_argument("--out", help="where the rows go; without it, the first ones are shown")
    p.add_argument("--format", choices=FORMATS, default="parquet")
    p.add_argument("--rows", type=int, default=20, help="rows that are shown")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a setting of the Spark session")
    return p


def main(arguments: Sequence[str] | None = None) -> None:
    given = parameters().parse_args(arguments)
    if given.query is None:
        print(*sorted(catalogue.QUERIES), sep="\n")
        return
    if given.query not in catalogue.QUERIES:
        raise SystemExit(f"there is no query {given.query}")
    builder = SparkSession.builder.appName(f"stylomill {given.query}")
    for setting in given.set:
        key, _, value = setting.partition("=")
        builder = builder.config(key, value)
    found = catalogue.QUERIES[given.query](builder.getOrCreate(), given.data)
    if given.out:
        found.write.options(**FORMATS[given.format]).format("csv" if given.format == "tsv" else given.format).mode("overwrite").save(given.out)
    else:
        found.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
