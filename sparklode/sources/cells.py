"""From Parquet tables to cells: one row for each value that is not null or empty, with the address of its row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship
from .files import for_spark

#: Row groups up to which their table is broadcast; beyond it the join by file shuffles.
BROADCAST_ROWS = 1_000_000

ADDRESS = ["file_path", "row_group", "row_in_group"]


def file_path() -> Column:
    """The file of a row, written as the file listing writes it."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")


def row_groups(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(file_path, row_group, first_row, num_rows, file_size, file_modified) of the files of table, from their footers;
    the footers are read by tasks."""
    ship(spark)

    def run(batches):
        import pyarrow.parquet as pq

        from sparklode.sources.files import filesystem

        for b in batches:
            out = []
            for uri in b.column(0).to_pylist():
                system, path = filesystem(uri)
                info = system.get_file_info(path)
                with system.open_input_file(path) as f:
                    m = pq.ParquetFile(f).metadata
                first = 0
                for k in range(m.num_row_groups):
                    n = m.row_group(k).num_rows
                    out.append((uri, k, first, n, info.size, info.mtime))
                    first += n
            if out:
                cols = list(zip(*out))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file_path", "row_group", "first_row", "num_rows", "file_size", "file_modified"])

    files = sorted(table.inputFiles())
    paths = spark.createDataFrame([(f,) for f in files], "file_path string").repartition(max(1, min(len(files), 2000)))
    return paths.mapInArrow(run, "file_path string, row_group int, first_row long, num_rows long, file_size long, file_modified timestamp")


def numbered(groups: DataFrame) -> DataFrame:
    """(file_path, row_group, base, num_rows) of row groups: base is the number of a group's first row in the whole table, whose
    files follow each other by name. A table that is written in the order of a key is so numbered in that order."""
    rows = groups.select("file_path", "row_group", "num_rows").withColumn("base", F.sum("num_rows").over(Window.orderBy("file_path", "row_group")) - F.col("num_rows"))
    return F.broadcast(rows) if groups.count() <= BROADCAST_ROWS else rows


def table_rows(rows: DataFrame, groups: DataFrame, row: str = "row", places=None) -> DataFrame:
    """rows, numbered in the whole table in place of their row group: its file is '' and its row group 0. places: those of
    order.places, if the rows are numbered by a key that the files do not follow."""
    if places is not None:
        return places.number(rows, row)
    at = rows.join(numbered(groups).drop("num_rows"), ["file_path", "row_group"]).withColumn(row, F.col(row) + F.col("base"))
    return at.withColumns({"file_path": F.lit(""), "row_group": F.lit(0)}).select(*rows.columns)


def leaves(schema: T.StructType, prefix: str = "", at: Column | None = None) -> list[tuple[str, Column]]:
    """(dotted name, text or array of texts) of each leaf column, in schema order. Maps have no text form and are refused."""
    out = []
    for f in schema.fields:
        name = prefix + f.name
        col = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
        kind = f.dataType
        if isinstance(kind, T.StructType):
            out += leaves(kind, name + ".", col)
        elif isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.MapType, T.StructType, T.ArrayType)):
            raise ValueError(f"column {name} of type {kind.simpleString()} can't be read as text; exclude it")
        else:
            out.append((name, col.cast("array<string>") if isinstance(kind, T.ArrayType) else col.cast("string")))
    return out


def addressed(spark: SparkSession, table: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """table with the address of each row: file, row group, and row within the group. groups: row_groups of the table, if
    they are at hand, as in a saved index."""
    meta = table.select("*", file_path().alias("file_path"), F.col("_metadata.row_index").alias("__row"))
    rg = cut(row_groups(spark, table), "row-groups") if groups is None else groups
    rg = rg.select(F.col("file_path").alias("__file"), "row_group", "first_row", "num_rows")
    if rg.count() <= BROADCAST_ROWS:
        rg = F.broadcast(rg)
    at = (F.col("file_path") == F.col("__file")) & (F.col("__row") >= F.col("first_row")) & (F.col("__row") < F.col("first_row") + F.col("num_rows"))
    return meta.join(rg, at).withColumn("row_in_group", F.col("__row") - F.col("first_row")).drop("__file", "first_row", "num_rows", "__row")


def unpivot(table: DataFrame, keys: list[str], columns: list[str] | None = None, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keys, column_name, column_pos and text of every cell of the given (default: all other) columns. Nulls and empty
    texts give no cell; the elements of an array are cells of one column. Unknown names among columns are ignored."""
    own = T.StructType([f for f in table.schema.fields if f.name not in keys and f.name not in exclude and (columns is None or f.name in columns)])
    picked = [(n, c) for n, c in leaves(own) if n not in exclude]
    if not picked:
        return table.select(*keys, F.lit("").alias("column_name"), F.lit(0).alias("column_pos"), F.lit("").alias("text")).limit(0)
    arrays = {n for n, c in picked if isinstance(table.select(c).schema[0].dataType, T.ArrayType)}
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("column_pos"), (c if n in arrays else F.array(c)).alias("texts")) for k, (n, c) in enumerate(picked)])
    if arrays:
        rows = table.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.column_name", "cell.column_pos", F.explode("cell.texts").alias("text"))
    else:
        flat = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("column_pos"), c.alias("text")) for k, (n, c) in enumerate(picked)])
        rows = table.select(*keys, F.explode(flat).alias("cell")).select(*keys, "cell.column_name", "cell.column_pos", "cell.text")
    return rows.filter("text IS NOT NULL AND text <> ''")


def cells(spark: SparkSession, path: str, columns: list[str] | None = None, exclude: list[str] | tuple[str, ...] = (), whole: bool = False, places=None) -> DataFrame:
    """The cells of a Parquet table (a file or a folder) with their rows' addresses; whole: as those of table_rows, with
    the places."""
    table = spark.read.parquet(for_spark(spark, path))
    wanted = [c for c in table.columns if c not in exclude and (columns is None or c in columns)]
    groups = cut(row_groups(spark, table), "row-groups")
    rows = addressed(spark, table.select(*[f"`{c}`" for c in wanted]) if wanted else table, groups)
    return unpivot(table_rows(rows, groups, "row_in_group", places) if whole else rows, ADDRESS, columns, exclude)
