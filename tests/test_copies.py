"""Pair queries on tables full of copies: results as the SQL says, and work by classes of equal items."""

import threading

import duckdb
import pytest

from strandex.operators import dedup
from strandex.plans import registry
from tests.conftest import SF
from tests.test_oracles import plain

QUERIES = ["a37_duplicate_statistics", "j21_match_scoring", "n4_n10_pair_scores", "n9_n11_keepers", "u5_n8_groups"]


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Three copies of the parts, and 40 more of one of them, some with a price, size or name of their own."""
    folder = str(tmp_path_factory.mktemp("copied"))
    duckdb.sql(
        f"""COPY (SELECT p_partkey + 100000 * i AS p_partkey, * EXCLUDE (p_partkey, i) FROM '{SF}/part.parquet', range(3) t(i)
        UNION ALL SELECT 900000 + i, CASE WHEN i % 7 = 0 THEN upper(p_name) ELSE p_name END, CASE WHEN i % 11 = 0 THEN NULL ELSE p_brand END, p_type, CAST(p_size + i % 3 AS INTEGER), p_retailprice + i % 20
        FROM (SELECT * FROM '{SF}/part.parquet' ORDER BY p_partkey LIMIT 1), range(40) t(i)) TO '{folder}/part.parquet' (FORMAT parquet)"""
    )
    return folder


@pytest.mark.parametrize("most", [dedup.CHUNK, 2])
@pytest.mark.parametrize("name", QUERIES)
def test_copies_agree_with_sql(name, most, spark, copied, monkeypatch):
    chunks = dedup.class_chunks
    monkeypatch.setattr(dedup, "class_chunks", lambda rows, key, same: chunks(rows, key, same, most))
    df = registry.queries()[name](spark, copied)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{copied}/part.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    order = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Items of one name: 60,000 or 20,000 equal ones; or 60,000 in 20,000 brands and types."""
    folders = {}
    for kind, n, size in (("groups", 1, 60000), ("pairs", 1, 20000), ("brands", 20000, 60000)):
        folders[kind] = str(tmp_path_factory.mktemp(kind))
        duckdb.sql(f"COPY (SELECT i AS p_partkey, 'bolt' AS p_name, 'B' || i % {n} AS p_brand, 'T' || i % {n} AS p_type, 1::INTEGER AS p_size, (i % {n}) * 20.0::DOUBLE AS p_retailprice FROM range({size}) t(i)) TO '{folders[kind]}/part.parquet' (FORMAT parquet)")
    return folders


@pytest.mark.parametrize(("name", "kind", "rows"), [("a37_duplicate_statistics", "groups", 1), ("j21_match_scoring", "brands", 60000), ("n4_n10_pair_scores", "pairs", 20000 * 19999 // 2), ("n9_n11_keepers", "groups", 59999), ("u5_n8_groups", "groups", 60000)])
def test_work_goes_with_the_result(name, kind, rows, spark, crowded):
    """Up to 1.8e9 pairs have the name in common; 60 s are not enough to go through them row by row in a task."""
    clock = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    clock.start()
    try:
        assert registry.queries()[name](spark, crowded[kind]).count() == rows
    finally:
        clock.cancel()


def test_chunk_is_itself_in_any_order_of_ids(spark):
    """The two sides of a pair are made apart, and a shuffle may bring a chunk's ids in another order on each."""
    side = "struct<name: string, chunk: long, ids: array<long>>"
    rows = [(("a", 0, [1, 2, 3]), ("a", 0, [3, 1, 2])), (("a", 0, [1, 2, 3]), ("a", 1, [0, 4])), ((None, 0, [7, 8]), (None, 0, [8, 7]))]
    pairs = spark.createDataFrame(rows, f"x {side}, y {side}")
    want = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert sorted(map(tuple, dedup.item_pairs(pairs).collect())) == want


def test_item_in_several_classes_ties_them(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (4, "c"), (5, "d"), (6, None)], "id long, name string")
    links = dedup.linked_classes(dedup.class_pairs(dedup.item_classes(rows, "id", ["name"]), ["name"], ["name"]))
    assert {tuple(r) for r in dedup.class_groups(rows, "id", ["name"], links).collect()} == {(1, 1), (2, 1), (3, 1)}
