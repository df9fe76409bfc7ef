"""An index that follows a stream: files that arrive in a folder are indexed once, into tables that open as an index.

A posting names its file, so a file's postings never change those of another, and appending is all that a new file needs.
Each micro-batch writes folders of its own, named by its number: a batch that is repeated after a failure replaces them.
The source hands every file to one batch, so a batch finds its files by itself and the stream keeps no state. There are no
membership filters of a growing index; the postings' Parquet Bloom filters take their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import Index, save_meta, write_postings
from ..session import cut
from ..sources.cells import ADDRESS, addressed, file_path, row_groups, unpivot


def start(spark: SparkSession, source: str, target: str, columns: list[str], trigger: dict | None = None):
    """Starts indexing the Parquet files that arrive in source; returns the streaming query. By default it takes what is
    there and ends; trigger={'processingTime': '1 minute'} keeps it running. Index(spark, target) searches what is there."""
    schema = spark.read.parquet(source).schema
    folder, name = source, None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        folder, _, name = source.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    files = (stream.option("pathGlobFilter", name) if name else stream).parquet(folder).select(file_path().alias("file_path"))
    save_meta(Index(spark, target), source, 0.01, columns)

    def append(batch: DataFrame, number: int) -> None:
        paths = sorted(r["file_path"] for r in batch.distinct().toLocalIterator())
        if not paths:
            return
        table = spark.read.schema(schema).parquet(*paths)
        groups = cut(row_groups(spark, table), "row-groups")
        cells = unpivot(addressed(spark, table.select(*[f"`{c}`" for c in columns]), groups), ADDRESS, columns)
        write_postings(Index(spark, target), cells, number)
        groups.write.mode("overwrite").parquet(f"{target}/row_groups/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", f"{target}/checkpoint").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def index_stream(spark: SparkSession, source: str, target: str, columns: list[str]) -> Index:
    """Indexes what is in source and returns the index of all that came so far."""
    start(spark, source, target, columns).awaitTermination()
    return Index(spark, target)
