"""AND, OR and NOT of searches, on rows of the table whatever the column of a hit, as merged ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import to_ranges
from .search import hit_rows

PLACE = ["file_path", "row_group"]


def all_of(results: list[DataFrame]) -> DataFrame:
    """(file_path, row_group, start_row, end_row) of the rows in every result; one that found nothing empties it."""
    if not results:
        raise ValueError("nothing to combine")
    tagged = [hit_rows(r).withColumn("__k", F.lit(k)) for k, r in enumerate(results)]
    rows = reduce(DataFrame.unionByName, tagged).groupBy(*PLACE, "row").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(results))
    return to_ranges(rows, PLACE)


def any_of(results: list[DataFrame]) -> DataFrame:
    """(file_path, row_group, start_row, end_row) of the rows in any result."""
    if not results:
        raise ValueError("nothing to combine")
    return to_ranges(reduce(DataFrame.unionByName, [hit_rows(r) for r in results]), PLACE)


def none_of(result: DataFrame, without: DataFrame) -> DataFrame:
    """(file_path, row_group, start_row, end_row) of the rows in result and not in without."""
    return to_ranges(hit_rows(result).join(hit_rows(without), [*PLACE, "row"], "left_anti"), PLACE)
