"""Rows of the table that a search found, and how much of the table that spares."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.cells import ADDRESS, BROADCAST_ROWS, addressed
from ..sources.cells import row_groups as footers
from ..sources.files import for_spark
from .postings import tasks, to_rows
from .search import hit_rows


#: Files with hits up to which the scan is told their names; beyond it all files are opened.
NAMED_FILES = 10_000
#: Ranges of hits up to which the driver holds them; beyond it the join computes them where they are.
LOCAL_RANGES = 10_000
#: Merged ranges up to which they are a filter of the scan.
FILTER_RANGES = 64
#: Bytes of the table's files whose rows one task joins with the hits.
TASK_BYTES = 16 << 20


def rows(spark: SparkSession, path: str | DataFrame, hits: DataFrame, columns: list[str] | None = None, row_groups: DataFrame | None = None) -> DataFrame:
    """The rows of the table at path (or of a table that is read from files) in any range of hits (file_path, row_group,
    start_row, end_row), each once, with all or the given columns. Unknown columns are ignored; if none is known,
    ValueError. row_groups: those of an index, which spares reading the footers. Files without a hit are not read.

    Few hits are found at once, by one job, and their rows are ranges of a filter, without a join if the ranges are few.
    """
    table = path if isinstance(path, DataFrame) else spark.read.parquet(for_spark(spark, path))
    keep = table.columns if columns is None else [c for c in columns if c in table.columns]
    if not keep:
        raise ValueError(f"the table has none of the columns {columns}")
    hits = hits.select("file_path", "row_group", "start_row", "end_row")
    scan = table.select(*[f"`{c}`" for c in keep])
    few = hits.limit(LOCAL_RANGES + 1).toArrow()
    if few.num_rows <= LOCAL_RANGES:  # the search ran; it need not run again for the join
        local = spark.createDataFrame(few, hits.schema)
        files = sorted(set(few.column("file_path").to_pylist()))
        merged = _merged(few, row_groups, files)
        if merged is not None:
            return scan.filter(_named(files) & merged).select(*[f"`{c}`" for c in keep])
        wanted = to_rows(local, "row_in_group").select(*ADDRESS)
        broadcast = pc.sum(pc.add(pc.subtract(few.column("end_row"), few.column("start_row")), 1)).as_py() <= BROADCAST_ROWS
    else:
        files = [r["file_path"] for r in hits.select("file_path").distinct().limit(NAMED_FILES + 1).collect()]
        wanted, broadcast = to_rows(hits, "row_in_group").select(*ADDRESS), False
    if len(files) <= NAMED_FILES:
        scan = scan.filter(_named(files))
    groups = cut(footers(spark, table), "row-groups") if row_groups is None else row_groups
    at = addressed(spark, scan, groups)
    if broadcast:
        wanted = F.broadcast(wanted.distinct())
    else:
        parts = _tasks(spark, groups.join(spark.createDataFrame([(f,) for f in files], "file_path string"), "file_path") if len(files) <= NAMED_FILES else groups)
        at, wanted = at.repartition(parts, *ADDRESS), wanted.repartition(parts, *ADDRESS).distinct()
    return at.join(wanted, ADDRESS, "left_semi").select(*[f"`{c}`" for c in keep])


def _tasks(spark: SparkSession, groups: DataFrame) -> int:
    """Tasks of a join of the rows of these row groups with hits, as many at most, by their number and their files' bytes."""
    files = groups.groupBy("file_path").agg(F.sum("num_rows").alias("rows"), F.max("file_size").alias("bytes"))
    all_ = files.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    return max(tasks(spark, 2 * (all_["rows"] or 0)), min(20_000, -(-(all_["bytes"] or 0) // TASK_BYTES)))


def _named(files: list[str]):
    names = files + [f.replace("file:///", "file:/", 1) for f in files if f.startswith("file:///")]
    return F.col("_metadata.file_path").isin(names) if names else F.lit(False)


def _merged(hits: pa.Table, row_groups: DataFrame | None, files: list[str]):
    """The hits as a condition on the rows' places in their files, if the row groups are at hand and the merged ranges few."""
    if not hits.num_rows:
        return F.lit(False)
    if row_groups is None:
        return None
    known = row_groups.filter(F.col("file_path").isin(files)).select("file_path", "row_group", "first_row").limit(LOCAL_RANGES + 1).collect()
    if len(known) > LOCAL_RANGES:
        return None
    first = {(r["file_path"], r["row_group"]): r["first_row"] for r in known}
    ranges: dict[str, list[list[int]]] = {}
    for f, g, lo, hi in sorted(zip(*(hits.column(c).to_pylist() for c in ("file_path", "row_group", "start_row", "end_row")))):
        own, base = ranges.setdefault(f, []), first[f, g]
        if own and base + lo <= own[-1][1] + 1:
            own[-1][1] = max(own[-1][1], base + hi)
        else:
            own.append([base + lo, base + hi])
    if sum(map(len, ranges.values())) > FILTER_RANGES:
        return None
    row, out = F.col("_metadata.row_index"), F.lit(False)
    for f, own in ranges.items():
        inside = F.lit(False)
        for lo, hi in own:
            inside = inside | row.between(lo, hi)
        out = out | (_named([f]) & inside) if len(ranges) > 1 else inside
    return out


def pruning(row_groups: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: row groups and rows in all, to read and skipped, and the skipped shares in per cent. A row that several
    columns hit counts once; no hits skip everything."""
    hit = hit_rows(hits).groupBy("file_path", "row_group").agg(F.count(F.lit(1)).alias("hit_rows"))
    per = row_groups.select("file_path", "row_group", "num_rows").join(hit, ["file_path", "row_group"], "left")
    out = per.agg(
        F.count(F.lit(1)).alias("total_row_groups"), F.count("hit_rows").alias("row_groups_to_read"), F.coalesce(F.sum("num_rows"), F.lit(0)).cast("long").alias("total_rows"), F.coalesce(F.sum("hit_rows"), F.lit(0)).cast("long").alias("rows_to_read")
    )
    out = out.withColumn("row_groups_skipped", F.col("total_row_groups") - F.col("row_groups_to_read")).withColumn("rows_skipped", F.col("total_rows") - F.col("rows_to_read"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) * 100.0 / F.col(b), 4)).otherwise(100.0)
    return out.withColumn("percent_row_groups_skipped", share("row_groups_skipped", "total_row_groups")).withColumn("percent_rows_skipped", share("rows_skipped", "total_rows"))
