"""Building, saving and opening an index of a Parquet table, its facts, and whether it still fits the table.

An index is a folder of Parquet tables: posting (sorted by keyword, with a Parquet Bloom filter on it), filter parameters,
bitmaps and sets, row_groups and meta.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import LEVELS
from ..session import cut
from ..sources.cells import cells, row_groups
from ..sources.files import for_spark, register, resolve
from . import filters, postings
from .shred import shred

VERSION = 1


#: Schemas of an index's tables, so that opening one infers nothing.
SCHEMAS = {
    "posting": postings.RUN_SCHEMA,
    "filter": "column_name string, kind string, num_items long, num_bits long, num_hashes int", "bitmap": "column_name string, word long, bits long", "set": "column_name string, keyword string",
    "row_groups": "file_path string, row_group int, first_row long, num_rows long, file_size long, file_modified timestamp",
    "meta": "version int, table_path string, error_rate double, delimiters array<string>, indexed_columns array<string>",
}
#: Words of Bloom filters, set members and row groups that an opened index holds on the driver; larger ones stay tables.
HELD_ROWS = 1_000_000


@dataclass
class Index:
    """An opened index. What a search needs of it besides postings is read once: its facts, its row groups and filters, if
    they are few. An index that is built anew is opened anew."""

    spark: SparkSession
    path: str
    prefix: str = ""

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{self.prefix}{name}")
        return table.select(*[x.split()[0] for x in SCHEMAS[name].split(", ")])

    @cached_property
    def posting(self) -> DataFrame:
        """All runs; those of a task's ends are held a second time, joined."""
        return self.read("posting").filter("edge IS NULL").drop("edge")

    @cached_property
    def tokens(self) -> DataFrame:
        """The distinct (column_name, keyword), written, in tasks that follow the number of postings."""
        return cut(self.posting.select("column_name", "keyword").distinct(), "names", postings.tasks(self.spark, self.posting.count()))

    @cached_property
    def row_groups(self) -> DataFrame:
        return self._held("row_groups")

    @cached_property
    def meta(self) -> dict:
        return self.read("meta").first().asDict()

    @property
    def table(self) -> str:
        return self.meta["table_path"]

    @cached_property
    def rows(self) -> DataFrame:
        """The indexed table."""
        return self.spark.read.parquet(for_spark(self.spark, self.table))

    def _held(self, name: str) -> DataFrame:
        """A table of the index, as a local one if it is small."""
        few = self.read(name).limit(HELD_ROWS + 1).toArrow()
        return self.spark.createDataFrame(few, self.read(name).schema) if few.num_rows <= HELD_ROWS else self.read(name)

    @cached_property
    def _filters(self) -> dict | None:
        """By column ('' for all): a set of tokens, or (bits, hashes, words); None if they are too large for the driver."""
        params = self.read("filter").collect()
        if not params or sum(r["num_bits"] // 64 + 1 if r["kind"] == "bloom" else r["num_items"] for r in params) > HELD_ROWS:
            return None
        words, sets = ({r["column_name"]: {} if x == "bitmap" else set() for r in params} for x in ("bitmap", "set"))
        for r in self.read("bitmap").toLocalIterator():
            words[r["column_name"]][r["word"]] = r["bits"]
        for r in self.read("set").toLocalIterator():
            sets[r["column_name"]].add(r["keyword"])
        return {r["column_name"]: sets[r["column_name"]] if r["kind"] == "set" else (r["num_bits"], r["num_hashes"], words[r["column_name"]]) for r in params}

    def might_contain(self, word: str, column: str | None = None) -> bool:
        """False only if the index surely lacks the token (in the column, if one is given), by its filters: the global one
        first, then the column's. Without filters on the driver always true; the postings' own Bloom filters then decide."""
        if self._filters is None:
            return True
        for name in (filters.GLOBAL,) if column is None else (filters.GLOBAL, column):
            held = self._filters.get(name)
            if held is None:
                return False
            if isinstance(held, set):
                if word not in held:
                    return False
                continue
            bits, hashes, words = held
            at = self.spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.lit(word)), F.lit(bits)) for k in range(1, hashes + 1)])).first()[0] if word not in self._places.setdefault(bits, {}) else self._places[bits][word]
            if len(self._places[bits]) < 10_000:
                self._places[bits][word] = at
            if not all(words.get(x // 64, 0) >> (x % 64) & 1 for x in at):
                return False
        return True

    @cached_property
    def _places(self) -> dict:
        return {}


#: How postings are written. parquet.bloom.filter.adaptive picks the size of each row group's Bloom filter by its tokens.
POSTING_OPTIONS = {
    "parquet.bloom.filter.enabled#keyword": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.expected.ndv#keyword": "400000",
    "parquet.enable.dictionary": "true", "parquet.block.size": str(8 << 20), "parquet.page.size": str(64 << 10),
}


def location(path: str) -> str:
    return resolve(path).rstrip("/") + ".index"


def save_meta(index: Index, path: str, error_rate: float, columns: list[str]) -> None:
    """Writes an index's facts, and its other tables without rows where there are none yet."""
    row = [(VERSION, path, float(error_rate), list(LEVELS), sorted(columns))]
    index.spark.createDataFrame(row, SCHEMAS["meta"]).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/{index.prefix}meta")
    for name in ("filter", "bitmap", "set"):
        index.spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{index.path}/{index.prefix}{name}")


def write_postings(index: Index, cells: DataFrame, batch: int = 0) -> None:
    """Writes the postings of cells, range-partitioned and sorted by keyword, as a batch of the index. Runs that two tasks
    share are joined into a small batch of their own, with a negative number. The occurrences are written first, so that the
    sample for the ranges does not shred the cells a second time."""
    at = f"{index.path}/{index.prefix}posting/batch="
    postings.run_parts(cut(shred(cells), "occurrences")).write.mode("overwrite").options(**POSTING_OPTIONS).parquet(f"{at}{batch}")
    ends = index.spark.read.schema(SCHEMAS["posting"]).parquet(f"{at}{batch}").filter("edge IS NOT NULL")
    joined = postings.whole_runs(ends).coalesce(1).sortWithinPartitions(*postings.PLACE, "start_row", "ord")
    joined.withColumn("edge", F.lit(None).cast("int")).write.mode("overwrite").options(**POSTING_OPTIONS).parquet(f"{at}{-1 - batch}")


def build(spark: SparkSession, path: str, index_path: str | None = None, columns: list[str] | None = None, exclude: list[str] | tuple[str, ...] = (), error_rate: float = 0.01, prefix: str = "") -> Index:
    """Indexes the Parquet table at path into index_path (default: path.index), replacing an index of the same prefix. A
    table without any token gives an empty, valid index."""
    filters.check_error_rate(error_rate)
    index = Index(spark, index_path or location(path), prefix)

    def save(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{index.path}/{prefix}{name}")

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index.path}/{prefix}posting")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    write_postings(index, cells(spark, path, columns, exclude))
    params, bitmaps, sets = filters.build(index.tokens, error_rate)
    save(params, "filter")
    save(bitmaps, "bitmap")
    save(sets, "set")
    save(row_groups(spark, spark.read.parquet(for_spark(spark, path))), "row_groups")
    indexed = [r["column_name"] for r in params.filter(F.col("column_name") != filters.GLOBAL).select("column_name").collect()]
    save_meta(index, path, error_rate, indexed)
    return Index(spark, index.path, prefix)


def build_in_memory(table: DataFrame, **how) -> Index:
    """The index of a DataFrame that is no table yet: both live in the shared folder of the session. how: as for build."""
    name = f"memory://table-{uuid.uuid4().hex}"
    register(name, table)
    return build(table.sparkSession, name, **how)


def exists(spark: SparkSession, path: str, index_path: str | None = None, prefix: str = "") -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{index_path or location(path)}/{prefix}meta/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def open_index(spark: SparkSession, path: str, index_path: str | None = None, prefix: str = "") -> Index:
    if not exists(spark, path, index_path, prefix):
        raise FileNotFoundError(f"no index at {index_path or location(path)}")
    index = Index(spark, index_path or location(path), prefix)
    version = index.meta["version"]
    if version != VERSION:
        raise ValueError(f"the index has version {version}, this program reads {VERSION}")
    return index


def info(index: Index) -> DataFrame:
    """One row: version, error_rate, files, row_groups, rows, table_bytes, modified (the latest file), columns, tokens,
    postings."""
    p = index.posting.agg(F.countDistinct("column_name").alias("columns"), F.countDistinct("keyword").alias("tokens"), F.count(F.lit(1)).alias("postings"))
    g = index.row_groups.agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("row_groups"), F.coalesce(F.sum("num_rows"), F.lit(0)).alias("rows"))
    files = index.row_groups.select("file_path", "file_size", "file_modified").distinct().agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("table_bytes"), F.max("file_modified").alias("modified"))
    g = g.crossJoin(files)  # of one row each
    return index.read("meta").select("version", "error_rate").crossJoin(g).crossJoin(p)


def validate(index: Index) -> DataFrame:
    """(file_path, status) of every file: ok, size, modified, missing or new, by its size and its time to the second."""
    old = index.row_groups.select("file_path", "file_size", "file_modified").distinct()
    now = row_groups(index.spark, index.spark.read.parquet(for_spark(index.spark, index.table))).select("file_path", F.col("file_size").alias("size"), F.col("file_modified").alias("modified")).distinct()
    second = lambda c: F.date_trunc("second", c)
    status = F.when(F.col("size").isNull(), "missing").when(F.col("file_size").isNull(), "new").when(F.col("size") != F.col("file_size"), "size")
    status = status.when(second("modified") != second("file_modified"), "modified").otherwise("ok")
    return old.join(now, "file_path", "full").select("file_path", status.alias("status"))
