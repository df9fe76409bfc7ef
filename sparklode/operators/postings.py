"""Occurrences to postings: run-length encoding over rows, tokens by column, and ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from ..sources.cells import numbered

PLACE = ["keyword", "column_name", "file_path", "row_group"]
#: Rows that are merged into ranges at once.
PIECE = 65_536
#: Occurrences that are encoded at once.
BATCH_ROWS = 50_000
#: Rows, as occurrences, that a task sorts or groups at most, about.
TASK_ROWS = 500_000
RUN_SCHEMA = "keyword string, column_name string, column_pos int, file_path string, row_group int, start_row long, end_row long, splits int, parent string, ord int, edge int"


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of a shuffle of so many rows: those of the session, or more, so that none has many more than TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def run_lengths(occurrences: DataFrame) -> DataFrame:
    """(keyword, column_name, column_pos, file_path, row_group, start_row, end_row, splits, parent, ord): runs of rows.

    In the order of rows and occurrences, one with the row and parent of the one before joins it, its bits too; then a run
    goes on as long as the next row follows with the same bits and parent. ord is that of the run's first occurrence.
    """
    return whole_runs(cut(run_parts(cut(occurrences, "occurrences")), "runs"))


def whole_runs(parts: DataFrame) -> DataFrame:
    """The runs of run_parts, written, with those that two tasks shared joined."""
    return joined(parts.withColumns({"head": F.coalesce(F.col("edge").bitwiseAND(1) != 0, F.lit(False)), "tail": F.coalesce(F.col("edge").bitwiseAND(2) != 0, F.lit(False))}).drop("edge"), PLACE)


def run_parts(occurrences: DataFrame) -> DataFrame:
    """run_lengths of occurrences that were written, but for runs that two tasks share; edge has bit 0 for a task's first run,
    bit 1 for its last, and is null for all others.

    Occurrences are sorted in tasks of about TASK_ROWS rows, also those of one token, and encoded as they stream by."""
    ship(occurrences.sparkSession)
    parts = tasks(occurrences.sparkSession, occurrences.count())
    rows = occurrences.select(*PLACE, "column_pos", "row_in_group", "splits", "parent", "ord")
    return rows.repartitionByRange(parts, *PLACE, "row_in_group").sortWithinPartitions(*PLACE, "row_in_group", "ord").mapInArrow(_encode, RUN_SCHEMA)


def _same(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row but the first equals the one before in the columns, nulls too."""
    out = np.ones(max(0, table.num_rows - 1), bool)
    for c in columns:
        whole = table.column(c)
        a, b = whole.slice(1), whole.slice(0, table.num_rows - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        if whole.null_count:
            same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        out &= same.to_numpy()
    return out


def _encode(batches):
    """Sorted occurrences to runs. What the next batch may still change is carried: the last entry, and the run before it."""
    entry = run = None  # tables of one row
    first = True

    def entries(table):
        same = _same(table, [*PLACE, "row_in_group", "parent"])
        at = np.flatnonzero(np.concatenate(([True], ~same)))
        bits = np.bitwise_or.reduceat(table.column("splits").to_numpy(), at)
        out = table.take(pa.array(at))
        return out.set_column(out.schema.get_field_index("splits"), "splits", pa.array(bits, pa.int32()))

    def runs(table):
        start, end = table.column("start_row").to_numpy(), table.column("end_row").to_numpy()
        goes_on = _same(table, [*PLACE, "splits", "parent"]) & (end[:-1] + 1 == start[1:])
        at = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        out = table.take(pa.array(at))
        return out.set_column(out.schema.get_field_index("end_row"), "end_row", pa.array(end[np.append(at[1:], len(end)) - 1]))

    def as_runs(done):
        done = done.rename_columns(["start_row" if c == "row_in_group" else c for c in done.column_names])
        done = done.append_column("end_row", done.column("start_row"))
        return runs(done if run is None else pa.concat_tables([run, done]))

    def out(done, last):
        nonlocal first
        edge = np.zeros(done.num_rows, np.int32)
        edge[0] |= first
        edge[-1] |= 2 * last
        first = False
        done = done.append_column("edge", pa.array(edge, pa.int32(), mask=edge == 0)).select([x.split()[0] for x in RUN_SCHEMA.split(", ")])
        return done.combine_chunks().to_batches()

    def gathered():
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BATCH_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    for table in gathered():
        done = entries(table if entry is None else pa.concat_tables([entry, table]))
        entry, done = done.slice(done.num_rows - 1), done.slice(0, done.num_rows - 1)
        if done.num_rows:
            whole = as_runs(done)
            run = whole.slice(whole.num_rows - 1)
            if whole.num_rows > 1:
                yield from out(whole.slice(0, whole.num_rows - 1), False)
    if entry is not None:
        yield from out(as_runs(entry), True)


def column_tokens(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("column_name", "keyword").distinct()


def total_occurrences(postings: DataFrame) -> DataFrame:
    """(keyword, total_occurrences): rows in all runs of all columns."""
    return postings.groupBy("keyword").agg(F.sum(F.col("end_row") - F.col("start_row") + 1).alias("total_occurrences"))


def to_ranges(rows: DataFrame, place: list[str], row: str = "row") -> DataFrame:
    """place, start_row and end_row: distinct rows merged into ranges of consecutive ones. A place is merged in pieces of
    PIECE rows; then only the ranges at the pieces' ends meet, so that no task holds a large place."""
    w = Window.partitionBy(*place, "__at").orderBy(row)
    island = rows.select(*place, row).distinct().withColumn("__at", F.floor(F.col(row) / PIECE)).withColumn("__island", F.col(row) - F.row_number().over(w))
    ranges = island.groupBy(*place, "__at", "__island").agg(F.min(row).alias("start_row"), F.max(row).alias("end_row")).drop("__island")
    head = F.col("start_row") % PIECE == 0
    ranges = ranges.withColumn("__at", F.when(head | ((F.col("end_row") + 1) % PIECE == 0), F.lit(-1)).otherwise(F.col("__at")))
    v = Window.partitionBy(*place, "__at").orderBy("start_row")
    goes_on = head & (F.lag("end_row").over(v) + 1 == F.col("start_row"))
    runs = ranges.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(v))
    return runs.groupBy(*place, "__at", "__run").agg(F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row")).drop("__at", "__run")


def joined(runs: DataFrame, place: list[str]) -> DataFrame:
    """runs that were made apart, by place: one that begins a part (head) goes on with the one that ends the part before (tail),
    if its rows follow and bits and parent are the same. Only these are gathered; the others stay where they are."""
    edge = F.col("head") | F.col("tail")
    w = Window.partitionBy(*place).orderBy("start_row", "ord")
    goes_on = F.col("head") & (F.lag("end_row").over(w) + 1 == F.col("start_row")) & (F.lag("splits").over(w) == F.col("splits")) & F.lag("parent").over(w).eqNullSafe(F.col("parent"))
    met = runs.filter(edge).withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    keep = [c for c in runs.columns if c not in ("head", "tail")]
    same = [F.first(c).alias(c) for c in keep if c not in (*place, "start_row", "end_row", "ord")]
    met = met.groupBy(*place, "__run").agg(*same, F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"), F.min(F.struct("start_row", "ord")).alias("__o"))
    return runs.filter(~edge).select(*keep).unionByName(met.withColumn("ord", F.col("__o.ord")).select(*keep))


def in_table(runs: DataFrame, groups: DataFrame, places=None) -> DataFrame:
    """runs (of one token, if they lack keyword) of an index with these row groups, as those of the whole table as one row
    group: rows are numbered as in table_rows, and runs go on from group to group. places: as in table_rows; runs are then cut
    into rows, and these encoded anew in their order."""
    if places is not None:
        n = runs.agg(F.sum(F.col("end_row") - F.col("start_row") + 1)).first()[0] or 0
        rows = places.number(entries(runs, "row_in_group"), "row_in_group", n)
        given = {c: F.lit(v) for c, v in (("keyword", ""), ("column_pos", 0)) if c not in runs.columns}
        return run_lengths(rows.withColumns(given)).select(*runs.columns)
    at = runs.join(numbered(groups), ["file_path", "row_group"])
    at = at.withColumns({"head": F.col("start_row") == 0, "tail": F.col("end_row") + 1 == F.col("num_rows"), "start_row": F.col("start_row") + F.col("base"), "end_row": F.col("end_row") + F.col("base"), "file_path": F.lit(""), "row_group": F.lit(0)})
    return joined(at.select(*runs.columns, "head", "tail"), [c for c in ("keyword", "column_name") if c in runs.columns])


def to_rows(ranges: DataFrame, row: str = "row") -> DataFrame:
    """Each range's rows, one by one."""
    return ranges.withColumn(row, F.explode(F.sequence("start_row", "end_row")))


def entries(runs: DataFrame, row: str = "row") -> DataFrame:
    """to_rows of runs, with an ord that sorts those of a token, column and row: a run that began in a row before is the first."""
    rows = to_rows(runs, row)
    return rows.withColumn("ord", F.when(F.col("start_row") < F.col(row), -1).otherwise(F.col("ord")))
