import random

import pytest
from pyspark.sql import functions as F

from sparklode import cli
from sparklode.functions import tokens as K
from sparklode.operators import combine, fetch, filters, index, postings, search
from sparklode.sources import cells as C


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    """Two files of several row groups, with nulls, empty texts, a list and a struct column."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(1)
    folder = tmp_path_factory.mktemp("people") / "t.parquet"
    folder.mkdir()
    words = ["a/b", "b_b/c", "b/c", "user@example.com", "c_a/c", "c_a", "x y", "api.example.com", "example.com", "", None, "the quick-fox", "a b/c d", "b c"]
    rows = []
    for k in range(2):
        n = 60
        t = pa.table({"id": pa.array(range(k * n, k * n + n)), "s": [rng.choice(words) for _ in range(n)], "t": [rng.choice(words) for _ in range(n)], "tags": [[rng.choice(["p-q", "r"])] * (i % 3) for i in range(n)], "u": [{"v": rng.choice(["m.n", None])} for _ in range(n)]})
        pq.write_table(t, folder / f"part-{k}.parquet", row_group_size=25)
        rows += t.to_pylist()
    built = index.build(spark, str(folder), str(folder.parent / "i"))
    return built, rows, str(folder)


def where(rows):
    return [(i // 60, (i % 60) // 25, (i % 60) % 25) for i in range(len(rows))]


def found(df):
    return {(int(r["file_path"][-9]), r["row_group"], r["row"]) for r in search.hit_rows(df).collect()}


def test_row_groups_and_cells(spark, people):
    built, rows, path = people
    assert [(r.row_group, r.first_row, r.num_rows) for r in built.row_groups.orderBy("file_path", "row_group").collect()] == [(0, 0, 25), (1, 25, 25), (2, 50, 10)] * 2
    got = {(int(r.file_path[-9]), r.row_group, r.row_in_group, r.column_name, r.text) for r in C.cells(spark, path).collect()}
    want = set()
    for at, r in zip(where(rows), rows):
        for c, v in (("id", str(r["id"])), ("s", r["s"]), ("t", r["t"]), ("u.v", r["u"]["v"]), *[("tags", x) for x in r["tags"]]):
            if v:
                want.add((*at, c, v))
    assert got == want


def test_every_token_is_found_where_it_is(people):
    built, rows, _ = people
    for word in ("example", "b/c", "c", "fox", "p", "n", "17"):
        want = {at for at, r in zip(where(rows), rows) for v in [str(r["id"]), r["s"], r["t"], r["u"]["v"], *r["tags"]] if v and word in {k for k, _, _ in K.shred(v)}}
        assert found(search.keyword(built.posting, word)) == want
        own = {at for at, r in zip(where(rows), rows) if r["s"] and word in {k for k, _, _ in K.shred(r["s"])}}
        assert found(search.keyword(built.posting, word, "s")) == own
    assert search.keyword(built.posting, "nothing").count() == 0 and search.keyword(built.posting, "b", "nowhere").count() == 0
    assert search.in_column(built.posting, "fox", "s") and not search.in_column(built.posting, "fox", "u.v")
    assert {r.column_name for r in search.columns_with(built.posting, "m").collect()} == {"u.v"}


def model_phrase(cells, phrase, column):
    """A literal reading of the phrase rules over one file: {(column, row group, row): {status}}. cells in stored order."""
    wanted = K.split_phrase(phrase)
    posts = [(c, g, r, k, s, p) for c, g, r, v in cells for k, s, p in K.shred(v)]
    mine = [x for x in posts if column is None or x[0] == column]
    if len(wanted) < 2:
        return {x[:3]: {"confirmed"} for x in mine if x[3] in wanted}
    have = {w for w in wanted if any(x[3] == w for x in mine)}
    level = K.phrase_level(phrase)

    def up(text):
        fit = [x for x in posts if x[3] == text and next((k for k in range(4) if x[4] & (2 << k)), 4) >= level]
        if not fit:
            return "needs_verification"
        parent = fit[0][5]
        return "rejected" if parent is None else "confirmed" if phrase in parent else up(parent)

    out = {}
    for place in {x[:3] for x in mine}:
        parents = [{x[5] for x in mine if x[:3] == place and x[3] == w} for w in sorted(have)]
        if not have or not all(parents):
            continue
        status, same = set(), set.intersection(*parents)
        if len(set.union(*parents)) > 1 and len(parents) > 1 or None in same:
            status.add("needs_verification")
        status |= {"confirmed" if phrase in p else up(p) for p in same if p is not None}
        if status - {"rejected"}:
            out[place] = status - {"rejected"}
    return out


@pytest.mark.parametrize("phrase", ["example.com", "b/c", "a/c", "user@example.com", "quick-fox", "b c", "x zzz", "/usr", "c", "a b/c"])
@pytest.mark.parametrize("column", [None, "s"])
def test_phrase_statuses_follow_the_rules(people, phrase, column):
    built, rows, _ = people
    got = {}
    for r in search.phrase(built.posting, phrase, column).collect():
        got[(int(r.file_path[-9]), r.column_name, r.row_group, r.row)] = {k for k in ("confirmed", "needs_verification") if r[k]}
    want = {}
    for f in range(2):
        cells = []
        for g in range(3):
            for c in ("id", "s", "t", "tags", "u.v"):
                for (ff, gg, r), row in zip(where(rows), rows):
                    if (ff, gg) == (f, g):
                        values = row["tags"] if c == "tags" else [row["u"]["v"]] if c == "u.v" else [row[c]]
                        cells += [(c, g, r, str(v)) for v in values if v not in (None, "")]
        want |= {(f, *k): v for k, v in model_phrase(cells, phrase, column).items()}
    assert got == want


@pytest.mark.parametrize("phrase", ["example.com", "b/c", "/", "a/c", "exam", "quick-f", " b", "y", "zz"])
def test_strict_phrases_are_substrings(people, phrase):
    built, rows, _ = people
    got = {(r.column_name, int(r.file_path[-9]), r.row_group, r.row) for r in search.phrase_strict(built, phrase).collect()}
    want = {(c, *at) for at, r in zip(where(rows), rows) for c, vs in (("id", [str(r["id"])]), ("s", [r["s"]]), ("t", [r["t"]]), ("u.v", [r["u"]["v"]]), ("tags", r["tags"])) for v in vs if v and phrase in v}
    assert got == want


def test_combine_and_fetch(spark, people):
    built, rows, path = people
    a, b = search.keyword(built.posting, "b", "s"), search.keyword(built.posting, "c", "t")
    ra, rb = found(a), found(b)
    assert found(combine.all_of([a, b])) == ra & rb and found(combine.any_of([a, b])) == ra | rb and found(combine.none_of(a, b)) == ra - rb
    assert combine.all_of([a, search.keyword(built.posting, "nothing")]).count() == 0
    with pytest.raises(ValueError):
        combine.all_of([])
    ids = {r["id"] for at, r in zip(where(rows), rows) if at in ra}
    twice = a.unionByName(a)
    assert sorted(r["id"] for r in fetch.rows(spark, path, twice, ["id", "nowhere"]).collect()) == sorted(ids)
    with pytest.raises(ValueError):
        fetch.rows(spark, path, a, ["nowhere"])
    p = fetch.pruning(built.row_groups, twice).first()
    assert (p.total_row_groups, p.total_rows, p.rows_to_read) == (6, 120, len(ra)) and p.row_groups_to_read == len({x[:2] for x in ra})
    none = fetch.pruning(built.row_groups, search.keyword(built.posting, "nothing")).first()
    assert none.rows_to_read == 0 and none.percent_rows_skipped == 100


def test_ranges(spark):
    rows = spark.createDataFrame([("f", r) for r in (1, 2, 3, 3, 7, 9, 10)], "file_path string, row long")
    assert sorted((r.start_row, r.end_row) for r in postings.to_ranges(rows, ["file_path"]).collect()) == [(1, 3), (7, 7), (9, 10)]


def test_run_lengths(spark):
    occ = [("k", "c", 0, "f", 0, row, o, s, p) for row, o, s, p in [(0, 0, 30, None), (1, 0, 30, None), (1, 3, 30, None), (2, 0, 30, "p"), (3, 0, 24, "p"), (5, 0, 24, "p"), (5, 1, 4, "p"), (5, 2, 24, "q")]]
    df = spark.createDataFrame(occ, "keyword string, column_name string, column_pos int, file_path string, row_group int, row_in_group long, ord int, splits int, parent string")
    got = sorted((r.start_row, r.end_row, r.splits, r.parent or "") for r in postings.run_lengths(df).collect())
    assert got == [(0, 1, 30, ""), (2, 2, 30, "p"), (3, 3, 24, "p"), (5, 5, 24, "q"), (5, 5, 28, "p")]


def test_filters(spark, people):
    names = spark.createDataFrame([("big", f"w{k}") for k in range(1000)] + [("small", f"s{k}") for k in range(5)], "column_name string, keyword string")
    params, bitmaps, sets = filters.build(names)
    by = {r.column_name: r for r in params.collect()}
    assert (by["big"].kind, by["big"].num_bits, by["big"].num_hashes) == ("bloom", 9586, 7) and by["small"].kind == "set" and by[""].num_items == 1005
    assert filters.probe(names, params, bitmaps, sets).filter("NOT might_contain").count() == 0
    absent = names.withColumn("keyword", F.concat(F.lit("no"), "keyword"))
    assert filters.probe(absent, params, bitmaps, sets).filter("might_contain").count() <= 50
    for bad in (0, 0.6, 1e-11):
        with pytest.raises(ValueError):
            filters.check_error_rate(bad)


def test_info_validation_and_absence(spark, people, tmp_path):
    built, rows, path = people
    info = index.info(built).first()
    assert (info.files, info.row_groups, info.rows, info.columns) == (2, 6, 120, 5)
    assert {r.status for r in index.validate(built).collect()} == {"ok"}
    assert not index.exists(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, str(tmp_path / "none"))
    table = str(tmp_path / "t.parquet")
    spark.createDataFrame([("a",)], "s string").coalesce(1).write.parquet(table)
    i = index.build(spark, table, prefix="v2_")
    assert index.exists(spark, table, prefix="v2_") and not index.exists(spark, table)
    spark.createDataFrame([("b c d",)], "s string").coalesce(1).write.mode("overwrite").parquet(table)
    assert {r.status for r in index.validate(i).collect()} == {"missing", "new"}


def test_table_without_tokens(spark, tmp_path):
    table = str(tmp_path / "t.parquet")
    spark.createDataFrame([(None,), ("",), (" ",)], "s string").write.parquet(table)
    i = index.build(spark, table)
    assert index.info(i).first().tokens == 0 and search.search(i, "a b").count() == 0


def test_maps_are_refused(spark):
    df = spark.sql("SELECT map('a', 1) AS m, 'x' AS s")
    with pytest.raises(ValueError):
        C.unpivot(df, [])
    assert C.unpivot(df, [], exclude=["m"]).count() == 1


def test_command_line(spark, people, tmp_path, capsys):
    _, _, path = people
    at = ["--index", str(tmp_path / "i")]
    assert cli.main(["search", path, "b", *at], spark) == 1
    assert cli.main(["index", path, "--exclude", "u", *at], spark) == 0
    assert cli.main(["search", path, "b/c", "--rows", "2", "--select", "id", *at], spark) == 0
    assert cli.main(["search", path, "b/c", "--strict", *at], spark) == 0 and cli.main(["search", path, "c", "--keyword", "--column", "s", *at], spark) == 0
    assert cli.main(["index-info", path, *at], spark) == 0
    assert cli.main(["nonsense"], spark) == 1 and cli.main(["index", path, "--error-rate", "0.9", *at], spark) == 1


def test_stream_appends(spark, tmp_path):
    from sparklode.streaming.append import index_stream

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a b",)], "s string").coalesce(1).write.parquet(source)
    assert index_stream(spark, source, target, ["s"]).posting.count() == 2
    spark.createDataFrame([("c a/b",)], "s string").coalesce(1).write.mode("append").parquet(source)
    i = index_stream(spark, source, target, ["s"])
    assert {r.keyword for r in i.posting.collect()} == {"a", "b", "c", "a/b"}
    assert {r.status for r in index.validate(i).collect()} == {"ok"} and index.info(i).first().files == 2
    assert [r.s for r in fetch.rows(spark, i.rows, search.lookup(i, "c"), row_groups=i.row_groups).collect()] == ["c a/b"]
    assert search.phrase_strict(i, "a/b").count() == 1 and search.lookup(i, "zzz").count() == 0


def test_tables_in_memory(spark):
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    from sparklode.sources import files

    i = index.build_in_memory(spark.createDataFrame([(1, "x/y"), (2, "z")], "id long, s string"), exclude=["id"])
    assert [r.id for r in fetch.rows(spark, i.rows, search.search(i, "x/y"), row_groups=i.row_groups).collect()] == [1]
    held = io.BytesIO()
    pq.write_table(pa.table({"id": [7, 8], "s": ["p q", "r"]}), held)
    name = files.register_bytes(spark, "memory://bytes", held.getvalue())
    i = index.build(spark, name)
    assert index.exists(spark, name) and [r.id for r in fetch.rows(spark, name, search.lookup(i, "q")).collect()] == [7]
    files.unregister(name)
    with pytest.raises(FileNotFoundError):
        index.exists(spark, name)


def test_uris():
    from sparklode.sources.files import split

    assert split("/a/b") == ("file:///a/b", False) and split("file:///a?b") == ("file:///a?b", False)
    assert split("s3a://b/k") == ("s3://b/k", False) and split("s3://b/k?anon=true") == ("s3://b/k", True) and split("s3://b/k?anon=1")[1]
    assert split("s3://b/k?anon=no")[1] is False and split("abfss://c@d/k")[0] == "abfs://c@d/k"


def test_filters_reject_before_postings_are_read(people):
    built, _, _ = people
    assert built.might_contain("example") and built.might_contain("example", "s") and not built.might_contain("no such token")
    assert not built.might_contain("fox", "id") and not built.might_contain("fox", "nowhere")
    known = {(r.column_name, r.keyword) for r in built.posting.select("column_name", "keyword").distinct().collect()}
    assert all(built.might_contain(k, c) for c, k in known)
    assert search.lookup(built, "no such token").count() == 0


def test_summary_of_a_search(people):
    built, rows, _ = people
    r = search.summary(built, "b/c", "s").first()
    assert r.tokens == ["b", "b/c", "c"] and r.found and r.columns == ["s"] and r.total_occurrences + r.to_verify >= sum(x["s"] == "b/c" for x in rows)
    none = search.summary(built, "absent", keyword_only=True).first()
    assert not none.found and none.total_occurrences == 0 and none.columns == []


def test_fetch_by_ranges_and_by_join(spark, people, monkeypatch):
    built, rows, _ = people
    hits = search.lookup(built, "c")
    want = sorted(r.id for r in fetch.rows(spark, built.rows, hits, ["id"]).collect())
    for ranges, local in ((64, 10_000), (0, 10_000), (0, 0)):
        monkeypatch.setattr(fetch, "FILTER_RANGES", ranges)
        monkeypatch.setattr(fetch, "LOCAL_RANGES", local)
        assert sorted(r.id for r in fetch.rows(spark, built.rows, hits, ["id"], built.row_groups).collect()) == want


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from sparklode.session import shared_dir

    sc = SimpleNamespace(master="spark://x", _conf={}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=sc))
