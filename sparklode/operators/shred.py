"""Cells to token occurrences, as an Arrow generator and as a pure Catalyst plan with the same rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens as K
from ..session import ship

#: Bytes of a table's files whose cells one task brings together.
TASK_BYTES = 4 << 20

_OUT = [T.StructField("ord", T.IntegerType()), T.StructField("keyword", T.StringType()), T.StructField("splits", T.IntegerType()), T.StructField("parent", T.StringType())]


def shred(cells: DataFrame) -> DataFrame:
    """The columns of cells other than text, and ord, keyword, splits and parent of every occurrence; ord counts a cell's
    occurrences in their order. One Arrow pass, no shuffle."""
    ship(cells.sparkSession)
    keep = [f for f in cells.schema.fields if f.name != "text"]

    def run(batches):
        cut = K.Shredder()
        for b in batches:
            text = b.column(b.num_columns - 1)
            for lo in range(0, b.num_rows, 1000):
                got = [cut(t) if t else [] for t in text.slice(lo, 1000).to_pylist()]
                n = np.array([len(g) for g in got])
                flat = [x for g in got for x in g]
                if not flat:
                    continue
                rows = pa.array(np.repeat(np.arange(lo, lo + len(n)), n))
                words, bits, parents = zip(*flat)
                inner = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                cols = [b.column(k).take(rows) for k in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(inner), pa.array(words, pa.string()), pa.array(bits, pa.int32()), pa.array(parents, pa.string())], [f.name for f in keep] + [f.name for f in _OUT])

    return cells.select(*[f"`{f.name}`" for f in keep], "text").mapInArrow(run, T.StructType(keep + _OUT))


def counted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column_name, keyword, splits, parent and n: how often each occurrence of shred is in the cells of the same keys and
    column. The cells are brought together by their keys and counted one after the other, so that texts are shuffled once and
    occurrences never, and no task holds more than the counts of one key."""
    ship(cells.sparkSession)
    by = [*keys, "column_name"]
    kinds = [cells.schema[k] for k in by]
    out = T.StructType([*kinds, *_OUT[1:], T.StructField("n", T.LongType())])

    def run(batches):
        cut = K.Shredder()
        at, counts, held, n = None, Counter(), [], 0

        def batch():
            places, got = zip(*held)
            sizes = np.array([len(g) for g in got])
            rows = pa.array(np.repeat(np.arange(len(got)), sizes))
            words, bits, parents = zip(*[x for g in got for x in g])
            whole = [pa.array(c, t).take(rows) for c, t in zip(zip(*places), types)]
            return pa.RecordBatch.from_arrays([*whole, pa.array(words, pa.string()), pa.array(bits, pa.int32()), pa.array(parents, pa.string()), pa.array([x for g in got for x in g.values()], pa.int64())], out.names)

        for b in batches:
            types = [b.column(k).type for k in range(len(by))]
            for place, text in zip(zip(*[b.column(k).to_pylist() for k in range(len(by))]), b.column(len(by)).to_pylist()):
                if place != at:
                    if counts:
                        held.append((at, counts))
                        n += len(counts)
                    at, counts = place, Counter()
                    if n >= 20_000:
                        yield batch()
                        held, n = [], 0
                counts.update(cut(text))
        if counts:
            held.append((at, counts))
        if held:
            yield batch()

    return near(cells, keys).sortWithinPartitions(*by).select(*by, "text").mapInArrow(run, out)


def near(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells, those of the same keys in one task, in tasks of about TASK_BYTES of the table's files."""
    size = int(cells._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes())
    return cells.repartition(max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-size // TASK_BYTES))), *keys)


def statistics(cells: DataFrame) -> DataFrame:
    """(keyword, column_name, occurrences, rows, splits) of the cells with the addresses of sources.cells, counted in the tasks
    that read them: the cells of a row and column follow each other there, so each row counts once."""
    ship(cells.sparkSession)
    place = ["column_name", "file_path", "row_group", "row_in_group"]

    def run(batches):
        cut = K.Shredder()
        at, seen, held = None, set(), {}

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in held], pa.string()), pa.array([c for _, c in held], pa.string()), *[pa.array([x[k] for x in held.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]], ["keyword", "column_name", "occurrences", "rows", "splits"]
            )

        for b in batches:
            for *here, text in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)]):
                if here != at:
                    at, seen = here, set()
                for word, bits, _ in cut(text):
                    own = held.setdefault((word, here[0]), [0, 0, 0])
                    own[0] += 1
                    own[2] |= bits
                    if word not in seen:
                        seen.add(word)
                        own[1] += 1
            if len(held) > 100_000:
                yield batch()
                held = {}
        if held:
            yield batch()

    parts = cells.select(*place, "text").mapInArrow(run, "keyword string, column_name string, occurrences long, rows long, splits int")
    return parts.groupBy("keyword", "column_name").agg(F.sum("occurrences").alias("occurrences"), F.sum("rows").alias("rows"), F.bit_or("splits").alias("splits"))


def shred_plan(cells: DataFrame) -> DataFrame:
    """The same occurrences by four generator steps inside Catalyst; ord is an array that sorts as the number in shred."""
    keys = [c for c in cells.columns if c != "text"]
    state = cells.filter("text IS NOT NULL AND text <> ''").select(*keys, "text", F.lit(1).alias("bits"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("done"), F.array().cast("array<int>").alias("ord"))
    kind = "array<struct<text:string,bits:int,parent:string,done:boolean>>"
    for level in range(4):
        own = 2 << level
        parts = F.filter(F.split("text", K.char_class(level), -1), lambda x: x != "")
        s = state.withColumn("parts", F.when(~F.col("done"), parts))
        whole = (F.size("parts") == 1) & (F.col("parts")[0] == F.col("text"))

        def child(own):
            return lambda x: F.struct(x.alias("text"), F.lit(own).alias("bits"), F.when(F.col("bits") != 1, F.col("text")).alias("parent"), F.lit(False).alias("done"))

        emitted = F.array(F.struct("text", "bits", "parent", F.lit(True).alias("done"))).cast(kind)
        nxt = F.when(F.col("done"), emitted)
        nxt = nxt.when(whole, F.array(F.struct("text", F.col("bits").bitwiseOR(F.lit(own)).alias("bits"), "parent", F.lit(False).alias("done"))).cast(kind))
        nxt = nxt.otherwise(F.concat(F.when(F.col("bits") != 1, emitted).otherwise(F.array().cast(kind)), F.transform("parts", child(own)).cast(kind)))
        state = s.select(*keys, "ord", F.posexplode(nxt).alias("at", "s")).select(*keys, "s.text", "s.bits", "s.parent", "s.done", F.concat("ord", F.array("at")).alias("ord"))
    return state.select(*keys, "ord", F.col("text").alias("keyword"), F.col("bits").alias("splits"), "parent")
