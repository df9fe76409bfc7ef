"""Run lengths of occurrences that are spread over tasks and batches, also those of one token."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparklode.operators import index, postings, search
from sparklode.sources import cells as C


def model(rows):
    """rows: (token, row, ord, splits, parent), sorted. A literal reading of run_lengths' docstring."""
    entries = []
    for k, row, o, s, p in rows:
        if entries and entries[-1][0] == k and entries[-1][1] == row and entries[-1][4] == p:
            entries[-1][3] |= s
        else:
            entries.append([k, row, o, s, p])
    out = []
    for k, row, o, s, p in entries:
        if out and (out[-1][0], out[-1][2] + 1, out[-1][3], out[-1][4]) == (k, row, s, p):
            out[-1][2] = row
        else:
            out.append([k, row, row, s, p, o])
    return out


def occurrences(n):
    rng = random.Random(n)
    rows, seen = [], {}
    for k in ("cold", "hot"):
        for row in range(n if k == "hot" else n // 50):
            for _ in range(rng.choice((0, 1, 1, 1, 1, 1, 2, 3))):
                seen[k, row] = seen.get((k, row), -1) + 1
                rows.append((k, row, seen[k, row], rng.choice((2, 2, 2, 2, 4)), rng.choice((None, None, None, None, "p"))))
    return rows


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_batches_do_not_cut_runs(monkeypatch, size):
    monkeypatch.setattr(postings, "BATCH_ROWS", 1)
    rows = occurrences(400)
    k, row, o, s, p = zip(*rows)
    n = len(rows)
    whole = pa.table({"keyword": k, "column_name": ["c"] * n, "file_path": ["f"] * n, "row_group": pa.array([0] * n, pa.int32()), "column_pos": pa.array([0] * n, pa.int32()), "row_in_group": row, "splits": pa.array(s, pa.int32()), "parent": pa.array(p, pa.string()), "ord": pa.array(o, pa.int32())})
    got = pa.Table.from_batches(list(postings._encode(iter(whole.to_batches(max_chunksize=size))))).to_pylist()
    assert [[r["keyword"], r["start_row"], r["end_row"], r["splits"], r["parent"], r["ord"]] for r in got] == model(rows)
    assert [r["edge"] for r in got] == [1] + [None] * (len(got) - 2) + [2]


def test_a_hot_token_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(postings, "TASK_ROWS", 300)
    rows = occurrences(3000)
    df = spark.createDataFrame([(k, "c", 0, "f", 0, row, o, s, p) for k, row, o, s, p in rows], "keyword string, column_name string, column_pos int, file_path string, row_group int, row_in_group long, ord int, splits int, parent string")
    assert postings.run_parts(df).filter("keyword = 'hot'").select(F.spark_partition_id()).distinct().count() > 5
    got = [[r.keyword, r.start_row, r.end_row, r.splits, r.parent, r.ord] for r in postings.run_lengths(df).orderBy("keyword", "start_row", "ord").collect()]
    assert got == model(rows)


def test_an_index_joins_the_runs_of_its_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "TASK_ROWS", 100)
    spark.range(0, 1000, 1, 1).select(F.lit("same a/b").alias("s")).write.parquet(str(tmp_path / "t"))
    i = index.build(spark, str(tmp_path / "t"))
    assert sorted((r.keyword, r.start_row, r.end_row) for r in i.posting.collect()) == [(k, 0, 999) for k in ("a", "a/b", "b", "same")]
    assert search.keyword(i.posting, "same").count() == 1 and index.info(i).first().postings == 4
    assert [r.n for r in C.row_groups(spark, i.rows).groupBy().agg(F.sum("num_rows").alias("n")).collect()] == [1000]


@pytest.mark.parametrize("piece", [1, 3, 65_536])
def test_ranges_go_on_from_piece_to_piece(spark, monkeypatch, piece):
    monkeypatch.setattr(postings, "PIECE", piece)
    rows = spark.createDataFrame([("f", r) for r in (0, 1, 2, 3, 4, 5, 6, 8, 11, 12, 20)] + [("g", 3)], "file_path string, row long")
    got = sorted(tuple(r) for r in postings.to_ranges(rows, ["file_path"]).collect())
    assert got == [("f", 0, 6), ("f", 8, 8), ("f", 11, 12), ("f", 20, 20), ("g", 3, 3)]


def test_statistics_and_counts_hold_across_cells_and_batches(spark, monkeypatch, tmp_path):
    from collections import Counter

    from sparklode.functions import tokens as K
    from sparklode.operators import shred

    rows = [(k % 7, ["a/b c", "a/b"] if k % 3 else ["a a"], "c-d" if k % 2 else None) for k in range(50)]
    spark.createDataFrame(rows, "id long, s array<string>, t string").coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(shred, "TASK_BYTES", 1)
    cells = [(k, i, c, x) for k, (i, s, t) in enumerate(rows) for c, xs in (("s", s), ("t", [t] if t else [])) for x in xs]
    occ = [(k, i, c, w, b, p) for k, i, c, x in cells for w, b, p in K.shred(x)]
    bits = {}
    for _, _, c, w, b, _ in occ:
        bits[w, c] = bits.get((w, c), 0) | b
    n, held = Counter((w, c) for _, _, c, w, _, _ in occ), Counter((w, c) for _, c, w in {(k, c, w) for k, _, c, w, _, _ in occ})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = shred.statistics(C.cells(spark, str(tmp_path / "t"), ["s", "t"])).collect()
        assert sorted(tuple(r) for r in got) == sorted((w, c, n[w, c], held[w, c], bits[w, c]) for w, c in n)
        by_id = shred.counted(C.unpivot(spark.read.parquet(str(tmp_path / "t")), ["id"], ["s", "t"]), ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    want = Counter((i, c, w, b, p) for _, i, c, w, b, p in occ)
    assert Counter({tuple(r)[:5]: r.n for r in by_id}) == want and len(by_id) == len(want)


def test_filters_of_one_column_are_built_and_probed_in_many_tasks(spark, monkeypatch):
    from sparklode.operators import filters

    monkeypatch.setattr(postings, "TASK_ROWS", 500)
    names = spark.range(3000).select(F.lit("c").alias("column_name"), F.concat(F.lit("word"), "id").alias("keyword"))
    params, bitmaps, sets = filters.build(names)
    spread = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert spread(bitmaps) > 8 and sets.count() == 0
    assert sorted((r.column_name, r.kind, r.num_items) for r in params.collect()) == [("", "bloom", 3000), ("c", "bloom", 3000)]
    got = filters.probe(names, params, bitmaps, sets)
    assert spread(got) > 8 and got.filter("might_contain").count() == got.count() == 3000


def test_the_tokens_of_an_index_are_gathered_in_tasks_by_its_postings(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "TASK_ROWS", 100)
    spark.range(0, 1000, 1, 1).select(F.concat(F.lit("t"), "id").alias("s")).write.parquet(str(tmp_path / "t"))
    i = index.build(spark, str(tmp_path / "t"))
    assert len(i.tokens.inputFiles()) > 8 and i.tokens.count() == 1000
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_many_rows_are_fetched_and_written_in_tasks_by_their_number(spark, monkeypatch, tmp_path):
    from sparklode import catalogue
    from sparklode.operators import fetch

    monkeypatch.setattr(fetch, "LOCAL_RANGES", 10)
    monkeypatch.setattr(postings, "TASK_ROWS", 100)
    monkeypatch.setattr(catalogue, "FILE_ROWS", 20)
    spark.range(0, 2000, 1, 1).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("event_type"), F.lit("p").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    i = index.build(spark, str(tmp_path / "events.parquet"), str(tmp_path / "i"), ["event_type"])
    for groups in (i.row_groups, None):
        got = fetch.rows(spark, i.rows, search.lookup(i, "even"), ["event_id"], groups)
        assert got.select(F.spark_partition_id()).distinct().count() > 8
        assert sorted(r.event_id for r in got.collect()) == list(range(0, 2000, 2))
    by_file = catalogue.by_file(spark, str(tmp_path))
    assert by_file.select(F.spark_partition_id()).distinct().count() > 8 and by_file.count() == 2000
