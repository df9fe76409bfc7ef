"""Searches in postings: tokens, membership, phrases by token parents, and phrases checked against the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..sources.cells import ADDRESS, addressed, table_rows, unpivot
from .index import Index
from .postings import entries, in_table, to_ranges, to_rows

_HIT = ["column_name", "file_path", "row_group", "start_row", "end_row"]


def keyword(postings: DataFrame, word: str, column: str | None = None) -> DataFrame:
    """(column_name, file_path, row_group, start_row, end_row, splits, parent, ord) of every run of the exact token, in one
    column or all. An unknown token or column gives no rows. The filter reaches the scan of a saved index."""
    hit = postings.filter(F.col("keyword") == word)
    return (hit if column is None else hit.filter(F.col("column_name") == column)).select(*_HIT, "splits", "parent", "ord")


def lookup(index: Index, word: str, column: str | None = None) -> DataFrame:
    """keyword, after the index's filters were asked: a token that they reject is not looked for."""
    if index.might_contain(word, column):
        return keyword(index.posting, word, column)
    return keyword(index.spark.createDataFrame([], index.posting.schema), word, column)


def in_column(postings: DataFrame, word: str, column: str) -> bool:
    return bool(keyword(postings, word, column).limit(1).count())


def columns_with(postings: DataFrame, word: str) -> DataFrame:
    return postings.filter(F.col("keyword") == word).select("column_name").distinct()


def hit_rows(hits: DataFrame) -> DataFrame:
    """(file_path, row_group, row) of hits, whatever the column."""
    return to_rows(hits.select("file_path", "row_group", "start_row", "end_row")).select("file_path", "row_group", "row").distinct()


def phrase_candidates(postings: DataFrame, phrase: str, column: str | None = None, by_file: bool = True) -> DataFrame:
    """(column_name, file_path, row_group, row, parents_by_token): rows of a column with every found token of the phrase.

    Tokens that a file (the whole table, unless by_file) does not hold at all (in the column, if one is given) are not asked
    for. parents_by_token has for each token the array of its parents in the row, with '' in place of none.
    """
    wanted = K.split_phrase(phrase)
    hits = postings.filter(F.col("keyword").isin(wanted) if wanted else F.lit(False))
    if column is not None:
        hits = hits.filter(F.col("column_name") == column)
    names = hits.select(_unit(by_file), "keyword").distinct()
    found = names.groupBy("unit").agg(F.count(F.lit(1)).alias("n_found"))
    rows = to_rows(hits.select("keyword", *_HIT, "parent"))
    by_token = rows.groupBy("column_name", "file_path", "row_group", "row", "keyword").agg(F.collect_set(F.coalesce("parent", F.lit(""))).alias("parents"))
    whole = by_token.groupBy("column_name", "file_path", "row_group", "row").agg(F.collect_list("parents").alias("parents_by_token"))
    return whole.withColumn("unit", _unit(by_file)).join(found, "unit").filter(F.size("parents_by_token") == F.col("n_found")).drop("unit", "n_found")


def _unit(by_file: bool):
    """Within what a phrase's tokens are counted and parents walked: the file, or the whole table."""
    return (F.col("file_path") if by_file else F.lit("")).alias("unit")


def _walk(postings: DataFrame, parents: DataFrame, phrase: str, by_file: bool, places=None) -> DataFrame:
    """(unit, parent, verdict) of distinct (unit, parent): confirmed, rejected or open.

    A parent that contains the phrase confirms. Else its first posting at the phrase's level or above it, in stored order
    over all columns, says what its own parent is: none rejects, and one is walked in turn. Each parent on the way has
    delimiters of lower levels only, so three steps reach the end. Over a whole table the order is by column, file and row, with
    places by column and their numbers.
    """
    level = K.phrase_level(phrase)
    state = parents.select("unit", "parent", F.col("parent").alias("at"), F.when(F.col("parent").contains(phrase), "confirmed").alias("verdict"))
    first = ["row_group", "column_pos", "start_row"] if by_file else ["column_pos", "file_path", "row_group", "start_row"] if places is None else ["column_pos", "row"]
    order = F.struct(*first, "ord")
    fit = (postings.filter(K.split_level(F.col("splits")) >= level) if level else postings).withColumn("unit", _unit(by_file))
    for _ in range(3):
        asked = state.filter("verdict IS NULL").select("unit", F.col("at").alias("keyword")).distinct()
        own = fit.join(asked, ["unit", "keyword"], "left_semi")
        own = own if by_file or places is None else places.number(entries(own), "row")
        up = own.groupBy("unit", F.col("keyword").alias("at")).agg(F.min_by("parent", order).alias("up"))
        up = up.withColumn("there", F.lit(True))
        verdict = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.col("there").isNull(), "open").when(F.col("up").isNull(), "rejected").when(F.col("up").contains(phrase), "confirmed")
        state = state.join(up, ["unit", "at"], "left").select("unit", "parent", F.coalesce("up", "at").alias("at"), verdict.alias("verdict"))
    return state.select("unit", "parent", F.coalesce("verdict", F.lit("open")).alias("verdict"))


def phrase(postings: DataFrame, text: str, column: str | None = None, by_file: bool = True, places=None) -> DataFrame:
    """(column_name, file_path, row_group, row, confirmed, needs_verification): rows that may hold the phrase.

    A phrase of one token is a keyword search, all confirmed. Otherwise, of a row's tokens: if they have different parents,
    or share none at all (whole cells' pieces), the row needs verification; a common parent that contains the phrase, or
    whose ancestors do, confirms; one whose ancestors end without it rejects. A row can be both confirmed and in need of
    verification through different occurrences, and one that is neither is left out. by_file: the rules hold within each
    file; otherwise the whole table is taken as one, in the order of its files or of the places.
    """
    wanted = K.split_phrase(text)
    if len(wanted) <= 1:
        rows = to_rows(keyword(postings, wanted[0] if wanted else "", column)).select("column_name", "file_path", "row_group", "row").distinct()
        return rows.select("*", F.lit(True).alias("confirmed"), F.lit(False).alias("needs_verification"))
    sets = phrase_candidates(postings, text, column, by_file)
    common = F.aggregate("parents_by_token", F.element_at("parents_by_token", 1), lambda a, x: F.array_intersect(a, x))
    union = F.array_distinct(F.flatten("parents_by_token"))
    rows = sets.select("column_name", "file_path", "row_group", "row", common.alias("common"), ((F.size("parents_by_token") > 1) & (F.size(union) > 1)).alias("mixed"))
    rows = rows.withColumn("unit", _unit(by_file))
    named = rows.select("unit", F.explode(F.filter("common", lambda p: p != "")).alias("parent")).distinct()
    verdicts = _walk(postings, named, text, by_file, places)
    each = rows.select("unit", "column_name", "file_path", "row_group", "row", "mixed", F.explode_outer("common").alias("parent")).join(verdicts, ["unit", "parent"], "left")
    return each.groupBy("column_name", "file_path", "row_group", "row").agg(
        F.bool_or(F.coalesce(F.col("verdict") == "confirmed", F.lit(False))).alias("confirmed"),
        F.bool_or(F.col("mixed") | F.coalesce(F.col("parent") == "", F.lit(False)) | F.coalesce(F.col("verdict") == "open", F.lit(False))).alias("needs_verification"),
    ).filter("confirmed OR needs_verification")


def phrase_strict(index: Index, text: str, column: str | None = None) -> DataFrame:
    """(column_name, file_path, row_group, row): exactly the cells whose text contains the phrase.

    The pieces inside the phrase are whole tokens, its first piece ends one and its last begins one; rows with all of them
    are candidates, and their cells are read and checked. A phrase of delimiters alone is checked on every cell.
    """
    pieces = K.atoms(text)
    inner = [F.col("keyword") == p for p in pieces[1:-1] if p]
    if len(pieces) == 1:
        tests = [F.col("keyword").contains(pieces[0])]
    else:
        tests = inner + ([F.col("keyword").endswith(pieces[0])] if pieces[0] else []) + ([F.col("keyword").startswith(pieces[-1])] if pieces[-1] else [])
    columns = [c for c in index.meta["indexed_columns"] if column is None or c == column]
    spark, roots = index.spark, sorted({c.split(".")[0] for c in columns})
    base = addressed(spark, index.rows.select(*[f"`{c}`" for c in roots]), index.row_groups)
    if tests:
        postings = index.posting if column is None else index.posting.filter(F.col("column_name") == column)
        any_test = tests[0]
        for t in tests[1:]:
            any_test = any_test | t
        flags = [F.max(t.cast("int")).alias(f"__t{k}") for k, t in enumerate(tests)]
        rows = to_rows(postings.filter(any_test)).groupBy("column_name", "file_path", "row_group", "row").agg(*flags)
        for k in range(len(tests)):
            rows = rows.filter(F.col(f"__t{k}") == 1)
        base = base.join(rows.select("file_path", "row_group", F.col("row").alias("row_in_group")).distinct(), ADDRESS, "left_semi")
    hit = unpivot(base, ADDRESS, roots).filter(F.col("text").contains(text))
    return hit.filter(F.col("column_name").isin(columns) if columns else F.lit(False)).select("column_name", "file_path", "row_group", F.col("row_in_group").alias("row")).distinct()


def phrase_rows(index: Index, text: str, column: str | None = None, by_file: bool = True, places=None) -> DataFrame:
    """phrase, after the index's filters were asked: tokens that they reject are not looked for."""
    found = any(index.might_contain(w, column) for w in K.split_phrase(text))
    return phrase(index.posting if found else index.posting.limit(0), text, column, by_file, places)


def search(index: Index, text: str, column: str | None = None, keyword_only: bool = False, by_file: bool = True, places=None) -> DataFrame:
    """(column_name, file_path, row_group, start_row, end_row, status, splits): the unified search, as ranges of rows; status
    is confirmed or needs_verification. splits are the bits of a token's runs; of a phrase, bit L for its lowest delimiter
    level L. Tokens that the index's filters reject are not looked for. Unless by_file the table is taken as one file of one
    row group, and rows are numbered so, by the places if they are given."""
    wanted = K.split_phrase(text)
    if keyword_only or len(wanted) == 1:
        hits = lookup(index, text if keyword_only else wanted[0], column)
        hits = (hits if by_file else in_table(hits, index.row_groups, places)).groupBy(*_HIT).agg(F.bit_or("splits").alias("splits"))
        return hits.select(*_HIT, F.lit("confirmed").alias("status"), "splits")
    rows = phrase_rows(index, text, column, by_file, places)
    rows = rows if by_file else table_rows(rows, index.row_groups, places=places)
    place = ["column_name", "file_path", "row_group"]
    sides = [to_ranges(rows.filter(s), place).withColumn("status", F.lit(s)) for s in ("confirmed", "needs_verification")]
    return sides[0].unionByName(sides[1]).select(*_HIT, "status", F.lit(1 << K.phrase_level(text)).alias("splits"))


def summary(index: Index, text: str, column: str | None = None, keyword_only: bool = False, by_file: bool = True, places=None) -> DataFrame:
    """One row: query, tokens asked for, found, columns (sorted), total_occurrences (rows in ranges that are confirmed),
    to_verify (in ranges that are not), and all bits of splits."""
    n = F.col("end_row") - F.col("start_row") + 1
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, n)), F.lit(0)).alias
    got = search(index, text, column, keyword_only, by_file, places).agg(F.sort_array(F.collect_set("column_name")).alias("columns"), of("confirmed")("total_occurrences"), of("needs_verification")("to_verify"), F.coalesce(F.bit_or("splits"), F.lit(0)).alias("splits"))
    tokens = [text] if keyword_only else K.split_phrase(text)
    return got.select(F.lit(text).alias("query"), F.array(*map(F.lit, tokens)).cast("array<string>").alias("tokens"), (F.size("columns") > 0).alias("found"), "columns", "total_occurrences", "to_verify", "splits")
