"""The queries against their SQL on tables whose files, by name, are not in the order of the key, as the SQL numbers rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_whole_table import MANY_FILES, QUERIES, against_sql

from sparklode import catalogue
from sparklode.operators import order


@pytest.fixture(scope="module")
def folder(sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("keys")
    for name in ("part", "events", *MANY_FILES):
        t = pq.read_table(f"{sf}/{name}.parquet").slice(0, 1000)
        k = t.num_rows // 3 + 1
        (at / f"{name}.parquet").mkdir()
        for i in range(3):
            own = t.slice(i * k, k).take(pa.array([x for s in range(5) for x in range(s, min(k, t.num_rows - i * k), 5)]))
            pq.write_table(own, at / f"{name}.parquet" / f"part-{2 - i:04d}.parquet", row_group_size=k // 2 + 1)
    return at


@pytest.mark.parametrize("name", [*QUERIES, "rle_postings_pages", "row_group_listing"])
def test_rows_are_numbered_by_the_key(spark, folder, name):
    assert against_sql(spark, folder, name) == [[], []]


@pytest.mark.parametrize(
    "files, ordered",
    [([[1, 2, 2], [2, 5]], True), ([[1, 3, 2], [4]], False), ([[4, 5], [1, 2]], False), ([[1, None], [2]], False), ([[], [1], [2]], True), ([[]], True), ([[2, 3, 4], [3]], False)],
)
def test_the_order_of_files_is_seen(spark, tmp_path, files, ordered):
    for i, keys in enumerate(files):
        pq.write_table(pa.table({"k": pa.array(keys, pa.int64())}), tmp_path / f"part-{i}.parquet", row_group_size=2)
    table = spark.read.parquet(str(tmp_path))
    assert order.in_order(spark, table, ["k"]) == ordered
    got = order.places(spark, table, ["k"])
    assert (got is None) == ordered
    if got:
        assert sorted(r["__at"] for r in got.table.collect()) == list(range(sum(map(len, files))))


def test_files_in_order_are_not_sorted(spark, sf):
    assert [catalogue.places_of(spark, sf, t) for t in catalogue.TABLES] == [None] * len(catalogue.TABLES)
