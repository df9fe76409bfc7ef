"""Substring predicates rewritten to index lookups, for callers that know an index; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fetch, search
from ..operators.index import Index


def where_contains(index: Index, column: str, text: str, columns: list[str] | None = None) -> DataFrame:
    """The table's rows whose column contains text: SELECT columns FROM table WHERE contains(column, text). The index names
    the rows, so only cells that hold the text's tokens are compared."""
    hits = search.phrase_strict(index, text, column)
    ranges = hits.select("file_path", "row_group", F.col("row").alias("start_row"), F.col("row").alias("end_row"))
    return fetch.rows(index.spark, index.rows, ranges, columns, index.row_groups)
