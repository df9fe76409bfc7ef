"""Numbers of a table's rows in the order of a key, for tables whose files do not follow each other in that order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship
from ..sources.cells import ADDRESS, addressed, file_path, row_groups
from .postings import tasks


@dataclass
class Places:
    """table: ADDRESS and __at, the number of each row; parts: tasks of a join with it, by its rows."""

    table: DataFrame
    parts: int

    def number(self, rows: DataFrame, row: str, n: int = 0) -> DataFrame:
        """rows (file_path, row_group, row, ...), numbered in the whole table in place of their row group. n: how many they are,
        if they may be many more than those of the table."""
        parts = max(self.parts, tasks(rows.sparkSession, n))
        own = rows.withColumnRenamed(row, "row_in_group").repartition(parts, *ADDRESS)
        at = own.join(self.table.repartition(parts, *ADDRESS), ADDRESS).drop("row_in_group").withColumnRenamed("__at", row)
        return at.withColumns({"file_path": F.lit(""), "row_group": F.lit(0)}).select(*rows.columns)


def in_order(spark: SparkSession, table: DataFrame, key: list[str]) -> bool:
    """Whether the rows of the table's files, by name, follow each other in the order of the key. Keys with nulls do not.

    Each task reads the key's columns and compares neighbours; only the first and last key of each stretch of a file meet."""
    ship(spark)
    kinds = [table.schema[k].dataType for k in key]
    ends = [T.StructField(f"{x}{i}", k) for x in ("first", "last") for i, k in enumerate(kinds)]
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("ordered", T.BooleanType()), *ends])
    width = len(key)

    def run(batches):
        last = start = None  # tables of one row: the one read last, and the first of its stretch
        ordered = True

        def stretch():
            return pa.RecordBatch.from_arrays([start.column(0).combine_chunks(), start.column(1).combine_chunks(), pa.array([ordered]), *[t.column(2 + k).combine_chunks() for t in (start, last) for k in range(width)]], schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if last is None:
                start = last = t.slice(0, 1)
                t = t.slice(1)
            whole = pa.concat_tables([last, t])
            a, z = whole.slice(0, whole.num_rows - 1), whole.slice(1)
            row = whole.column(1).to_numpy()
            follows = pc.equal(a.column(0), z.column(0)).to_numpy() & (row[1:] == row[:-1] + 1)
            after = np.ones(len(follows), bool)
            for k in reversed(range(2, 2 + width)):
                less, same = (pc.fill_null(f(a.column(k), z.column(k)), False).to_numpy() for f in (pc.less, pc.equal))
                after = less | same & after
            for k in range(2, 2 + width):
                ordered &= not whole.column(k).null_count
            lo = 0
            for hi in np.flatnonzero(~follows):
                ordered &= bool(after[lo:hi].all())
                last = whole.slice(hi, 1)
                yield stretch()
                start, ordered, lo = whole.slice(hi + 1, 1), not any(whole.column(2 + k).null_count for k in range(width)), hi + 1
            ordered &= bool(after[lo:].all())
            last = whole.slice(whole.num_rows - 1)
        if last is not None:
            yield stretch()

    read = table.select(file_path().alias("file"), F.col("_metadata.row_index").alias("row"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)])
    ends_ = read.mapInArrow(run, schema)
    first, before = F.struct(*[f"first{i}" for i in range(width)]), F.lag(F.struct(*[f"last{i}" for i in range(width)])).over(Window.orderBy("file", "row"))
    return ends_.select((F.col("ordered") & F.coalesce(before <= first, F.lit(True))).alias("ok")).agg(F.min(F.col("ok").cast("int"))).first()[0] != 0


def places(spark: SparkSession, table: DataFrame, key: list[str]) -> Places | None:
    """The places of the rows of a table that is read from files, in the order of the key's columns: nulls last, rows of the same
    key by file and row. None if the files are in that order, as cells.numbered has them.

    Keys are range-sorted in tasks by the number of rows; numbers are those within a task and the counts of the tasks before."""
    if in_order(spark, table, key):
        return None
    groups = cut(row_groups(spark, table), "row-groups")
    parts = tasks(spark, groups.agg(F.sum("num_rows")).first()[0] or 0)
    keyed = addressed(spark, table.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)]), groups)
    by = [*[F.col(f"__k{i}").asc_nulls_last() for i in range(len(key))], *ADDRESS]
    held = cut(keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*ADDRESS, F.monotonically_increasing_id().alias("__id")), "key-order")
    held = held.select(*ADDRESS, F.shiftright("__id", 33).alias("__task"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__n"))
    counts = held.groupBy("__task").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__task", (F.sum("n").over(Window.orderBy("__task")) - F.col("n")).alias("__before"))
    return Places(cut(held.join(F.broadcast(before), "__task").select(*ADDRESS, (F.col("__before") + F.col("__n")).alias("__at")), "places"), parts)
