"""The queries against their SQL on tables of several files and row groups, where rows of a row group are not those of the table."""

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E

MANY_FILES = ("pages", "documents", "conversations")
QUERIES = [
    "cells_unpivot", "exclude_columns", "combine_and", "combine_or", "combine_not", "rows_to_ranges", "keyword_search_all", "keyword_search_column", "keyword_search_path", "phrase_candidates", "phrase_status_dotted",
    "phrase_status_parts", "phrase_status_props", "phrase_status_url", "phrase_status_words", "search_phrase_url", "search_token", "search_summary", "phrase_strict_url", "rle_postings_events", "streaming_index", "search_many_files", "fetch_all_candidates",
]


@pytest.fixture(scope="module")
def folder(sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    for name in ("part", "events", *MANY_FILES):
        t = pq.read_table(f"{sf}/{name}.parquet").slice(0, 1000)
        k = t.num_rows // 3 + 1
        if name in MANY_FILES:
            (at / f"{name}.parquet").mkdir()
            for i in range(3):
                pq.write_table(t.slice(i * k, k), at / f"{name}.parquet" / f"part-{i:04d}.parquet", row_group_size=k // 2 + 1)
        else:
            pq.write_table(t, at / f"{name}.parquet", row_group_size=k)
    return at


def against_sql(spark, folder, name):
    """Rows of the query that its SQL lacks, and the other way round."""
    got = E.queries()[name](spark, str(folder)).toArrow()
    db = duckdb.connect()
    for p in folder.iterdir():
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    db.register("got", got)
    db.sql(f"CREATE TABLE want AS {E.oracle_sql()[name]}")
    columns = ", ".join(got.column_names)
    return [db.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall()[:5] for a, b in (("got", "want"), ("want", "got"))]


@pytest.mark.parametrize("name", QUERIES)
def test_rows_are_those_of_the_table(spark, folder, name):
    assert against_sql(spark, folder, name) == [[], []]
