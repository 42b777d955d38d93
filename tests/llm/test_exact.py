"""Exact duplicates."""

import pytest
from pyspark.sql import functions as F

from tributary.llm.exact import directory, drop_exact, exact_groups

PAIRS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, " a"), (7, "A"), (8, "a"), (9, "x" * 300_000), (10, "x" * 300_000), (10, "x" * 300_000)]


def verdicts(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


@pytest.mark.parametrize("key", [None, lambda c: F.length(c).cast("long"), lambda c: F.lit(7).cast("long")])
def test_groups_whatever_the_key(documents, scratch, key):
    """Keys that collide, or are all the same, change nothing: whole texts are compared."""
    got = verdicts(exact_groups(documents(PAIRS), scratch, key=key, capacity=1))
    assert got == sorted([(1, 8, 3, False), (3, 8, 3, False), (8, 8, 3, True), (2, 2, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True),
                          (7, 7, 1, True), (9, 10, 3, False), (10, 10, 3, True), (10, 10, 3, True)])


def test_null_ids_and_empty_tables(documents, scratch):
    rows = exact_groups(documents([(None, "a"), (1, "a"), (None, "b"), (None, "b")]), scratch).collect()
    assert sorted((r.doc_id is None, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(False, 1, 2, True), (True, 0, 2, True), (True, 0, 2, True), (True, 1, 2, False)]
    assert exact_groups(documents([]), scratch).count() == 0


def test_rows_keep_all_columns_with_clashing_names(documents, scratch):
    docs = documents(PAIRS[:8]).withColumns({c: F.lit(i) for i, c in enumerate(["key", "row", "bucket", "keep_id", "slot"])})
    out = drop_exact(docs, scratch)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 5, 6, 7, 8]


def test_directory_splits_overfull_buckets_only(spark):
    keys = [k << 32 for k in range(64)] + [-(k << 40) - 1 for k in range(5)]
    slots = directory(spark.createDataFrame([(k,) for k in keys], "key long"), 8).collect()
    by = {}
    for r in slots:
        by.setdefault((r.local_depth, r.bucket), []).append(r.keys)
        assert r.keys <= 8 and r.local_depth <= r.global_depth
    assert sum(map(sum, by.values())) == len(keys) and all(sum(v) <= 8 for v in by.values())
    assert len({d for d, _ in by}) > 1  # negative keys fit a bucket of a shorter prefix
