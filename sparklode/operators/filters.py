"""Membership filters: exact sets for columns with few tokens, Bloom filters for the others, kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .postings import tasks

#: Distinct tokens below which a column keeps the set itself.
SET_BELOW = 100
#: The name under which the filter over all columns is kept.
GLOBAL = ""


def check_error_rate(p: float) -> float:
    if not 1e-10 <= p <= 0.5:
        raise ValueError(f"the error rate must be between 1e-10 and 0.5, not {p}")
    return p


def parameters(members: DataFrame, error_rate: float = 0.01) -> DataFrame:
    """(column_name, kind, num_items, num_bits, num_hashes) for each column and, as '', for all of them, from the distinct
    (column_name, keyword) of both."""
    check_error_rate(error_rate)
    none = members.sparkSession.createDataFrame([(GLOBAL, 0)], "column_name string, num_items long")
    counts = members.groupBy("column_name").agg(F.count(F.lit(1)).alias("num_items")).unionByName(none).groupBy("column_name").agg(F.max("num_items").alias("num_items"))
    n = F.greatest(F.col("num_items"), F.lit(1)).cast("double")
    bits = F.ceil(-n * F.log(F.lit(float(error_rate))) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("long")
    kind = F.when(F.col("num_items") < SET_BELOW, "set").otherwise("bloom")
    out = counts.select("column_name", kind.alias("kind"), "num_items", bits.alias("num_bits"))
    return out.withColumn("num_hashes", F.greatest(F.lit(1), F.ceil(F.col("num_bits") / n * F.log(F.lit(2.0)))).cast("int"))


def _positions(tokens: DataFrame) -> DataFrame:
    """tokens joined with their filter's parameters, one row for each hash: the word and bit of the bitmap. Parameters are a row
    for each column and are broadcast to the tokens: a join by column would bring all tokens of one to a task."""
    hashed = tokens.withColumn("__seed", F.explode(F.sequence(F.lit(1), F.col("num_hashes"))))
    at = F.pmod(F.xxhash64("__seed", "keyword"), F.col("num_bits"))
    return hashed.withColumn("word", F.floor(at / 64).cast("long")).withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")))


def build(column_tokens: DataFrame, error_rate: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parameters, bitmaps, sets): bitmaps (column_name, word, bits) of the Bloom filters in words of 64 bits, sets
    (column_name, keyword) of the exact ones. No row holds a whole filter, so none is too large for one, and a task has a part
    of the words of all, however many tokens a column has."""
    check_error_rate(error_rate)
    spark = column_tokens.sparkSession
    both = column_tokens.select("column_name", "keyword").unionByName(column_tokens.select(F.lit(GLOBAL).alias("column_name"), "keyword"))
    members = cut(both.distinct(), "members", tasks(spark, 2 * column_tokens.count()))
    params = cut(parameters(members, error_rate), "filter")
    known = members.join(F.broadcast(params), "column_name")
    places = _by_word(_positions(known.filter("kind = 'bloom'")).select("column_name", "word", "bit"), tasks(spark, members.count() * _most_hashes(params)))
    return params, places.groupBy("column_name", "word").agg(F.bit_or("bit").alias("bits")), known.filter("kind = 'set'").select("column_name", "keyword")


def _by_word(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "column_name", "word")


def _most_hashes(params: DataFrame) -> int:
    return params.agg(F.max("num_hashes")).first()[0] or 1


def probe(wanted: DataFrame, params: DataFrame, bitmaps: DataFrame, sets: DataFrame) -> DataFrame:
    """(column_name, keyword, might_contain) of each distinct wanted (column_name, keyword); never false for a member."""
    spark = wanted.sparkSession
    distinct = cut(wanted.select("column_name", "keyword").distinct(), "asked", tasks(spark, wanted.count()))
    asked, n = distinct.join(F.broadcast(params), "column_name"), distinct.count()
    parts = tasks(spark, n * _most_hashes(params))
    place = _by_word(_positions(asked.filter("kind = 'bloom'")).select("column_name", "keyword", "word", "bit"), parts).join(_by_word(bitmaps, parts), ["column_name", "word"], "left")
    bloom = place.repartition(parts, "column_name", "keyword").groupBy("column_name", "keyword").agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).alias("might_contain"))
    exact = asked.filter("kind = 'set'").select("column_name", "keyword").join(sets.select("column_name", "keyword", F.lit(True).alias("there")), ["column_name", "keyword"], "left")
    return bloom.unionByName(exact.select("column_name", "keyword", F.coalesce("there", F.lit(False)).alias("might_contain")))
