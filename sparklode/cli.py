"""Command line: index a table, search it, and show what an index holds.

Exit codes: 0 done, 1 wrong usage, no index or another error, 2 the table changed since it was indexed, 3 that can't be told.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import fetch, index, search


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparklode", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("index", "build the index of a Parquet table"), ("search", "find rows by a phrase or a token"), ("index-info", "show an index's facts")):
        s = sub.add_parser(name, help=text)
        s.add_argument("table", help="path of the Parquet file or folder")
        s.add_argument("--index", help="folder of the index (default: TABLE.index)")
        s.add_argument("--prefix", default="", help="prefix of the index's tables")
        if name == "index":
            s.add_argument("--exclude", action="append", default=[], metavar="COLUMN")
            s.add_argument("--columns", action="append", metavar="COLUMN", help="index these columns only")
            s.add_argument("--error-rate", type=float, default=0.01)
        if name == "search":
            s.add_argument("text")
            s.add_argument("--column")
            s.add_argument("--keyword", action="store_true", help="one exact token instead of a phrase")
            s.add_argument("--strict", action="store_true", help="only cells whose text holds the phrase")
            s.add_argument("--rows", type=int, metavar="N", help="show up to N of the rows")
            s.add_argument("--select", action="append", metavar="COLUMN", help="columns of the rows to show")
    return p


def _stale(i: index.Index) -> int:
    try:
        bad = index.validate(i).filter("status != 'ok'").limit(1).count()
    except Exception as e:  # the table may be gone
        print(f"the index can't be compared with the table: {e}", file=sys.stderr)
        return 3
    if bad:
        print("the table changed since it was indexed", file=sys.stderr)
    return 2 if bad else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 1
    spark = spark or SparkSession.builder.appName("sparklode").getOrCreate()
    try:
        if a.command == "index":
            i = index.build(spark, a.table, a.index, a.columns, a.exclude, a.error_rate, a.prefix)
            index.info(i).show(truncate=False)
            return 0
        i = index.open_index(spark, a.table, a.index, a.prefix)
        if a.command == "index-info":
            index.info(i).show(truncate=False)
            i.read("filter").orderBy("column_name").show(1000, truncate=False)
            return 0
        if code := _stale(i):
            return code
        if a.strict:
            found = search.phrase_strict(i, a.text, a.column)
            hits = found.select("column_name", "file_path", "row_group", F.col("row").alias("start_row"), F.col("row").alias("end_row"), F.lit("confirmed").alias("status"))
        else:
            hits = search.search(i, a.text, a.column, a.keyword)
        hits = hits.cache()
        hits.groupBy("column_name", "status").agg(F.sum(F.col("end_row") - F.col("start_row") + 1).alias("rows")).orderBy("column_name", "status").show(1000, truncate=False)
        fetch.pruning(i.row_groups, hits).show(truncate=False)
        if a.rows:
            fetch.rows(spark, a.table, hits, a.select, i.row_groups).show(a.rows, truncate=False)
        return 0
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
