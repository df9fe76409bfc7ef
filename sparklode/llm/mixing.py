"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, in the order of a keyed hash, are a queue. A document's virtual finish time is the number of its
source's tokens up to and including it, divided by the source's target weight. The mixture is the documents in the order
of their finish times, up to the token budget: at every point each source that still has documents has given tokens in
proportion to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: A word for counting tokens: a run of anything but ASCII white space.
WORD = r"[^ \t\n\r\f]+"
#: Rows up to which the table of cut-offs (one for each source) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 10_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, part: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over all rows of the same part up to this one, peers included; no task sees a whole part.

    The rows are range-sorted by part and order and written; each range's sum gives the next one's start.
    """
    ranged = cut(df.repartitionByRange(*part, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*part, "__range").agg(F.sum(value).alias("__sum")).withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias("__s_" + c) for c in part], F.col("__range").alias("__s_range"), "__start")
    same = F.col("__range") == F.col("__s_range")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col("__s_" + c))
    inside = Window.partitionBy(*part, "__range").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(starts, same).withColumn(out, F.col("__start") + F.sum(value).over(inside)).select(*df.columns, out)


def _queue_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def schedule(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget_share: float = 0.5, budget_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, finish, total_tokens) of the chosen documents; total_tokens: the mixture's up to here.

    The budget is budget_tokens, or budget_share of all tokens. The order is (finish, source, hash, doc_id); the first
    document that would exceed the budget ends the mixture. A source that weights does not name, null among them, has
    default_weight; a weight of 0 leaves a source out. A null or empty text has 0 tokens and goes with the document
    before it. Repeated rows (same source and doc_id) share one finish time and are taken or left together. Other
    columns are ignored. An empty table gives an empty mixture.
    """
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("n_tokens"))
    base = cut(base.withColumn("key", _queue_key(F.col("doc_id"), seed)), "tokens")
    budget = budget_tokens if budget_tokens is not None else int((base.agg(F.sum("n_tokens")).first()[0] or 0) * budget_share)
    queued = running_sum(base.filter(weight > 0), ["source"], ["key", "doc_id"], "n_tokens", "cum")
    timed = queued.withColumn("finish", F.col("cum") / weight)
    total = running_sum(timed, [], ["finish", "source", "key", "doc_id"], "n_tokens", "total_tokens")
    return total.filter(F.col("total_tokens") <= budget).select("doc_id", "source", "n_tokens", "finish", "total_tokens")


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget_share: float = 0.5, budget_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """The rows of docs, all columns as they are, that schedule chooses.

    What is chosen of a source is the front of its queue, so one cut-off for each source decides, and no text is shuffled
    unless there are more than BROADCAST_ROWS sources.
    """
    chosen = schedule(docs, weights, default_weight, budget_share, budget_tokens, seed)
    last = chosen.groupBy("source").agg(F.max(F.struct(_queue_key(F.col("doc_id"), seed).alias("key"), F.col("doc_id").alias("doc_id"))).alias("last"))
    last = cut(last.select(F.struct("source", "last").alias("__cut")), "cutoffs")
    if last.count() <= BROADCAST_ROWS:
        last = F.broadcast(last)
    row = docs.select(F.struct("*").alias("__row"))
    own = F.struct(_queue_key(F.col("__row.doc_id").cast("long"), seed).alias("key"), F.col("__row.doc_id").cast("long").alias("doc_id"))
    return row.join(last, F.col("__row.source").cast("string").eqNullSafe(F.col("__cut.source")) & (own <= F.col("__cut.last"))).select("__row.*")
