"""Bit codes against direct recursion, bins against pandas."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from tributary.operators import cumulative, discretize
from tributary.operators.cumulative import RankedColumns, carried_forward, running_total
from tributary.operators.discretize import BinEdges, MedianCodes, MedianTree, median_codes, stored_codes


def brute(values, depth):
    """Codes of a list of numbers, None for an unsplit root; written from the definition."""

    def code(x, node, left):
        if left == 0:
            return ""
        med = statistics.median(node)
        if med == max(node):
            return ""
        side = [v for v in node if v <= med] if x <= med else [v for v in node if v > med]
        return ("0" if x <= med else "1") + code(x, side, max(left - 1, -1))

    known = [v for v in values if v is not None]
    out = ["nan" if v is None else code(v, known, depth) for v in values]
    return None if known and not code(known[0], known, depth) and statistics.median(known) == max(known) else out


def fit_codes(spark, values, depth, range_rows=None):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], "i int, v double").repartition(3)
    fitted = median_codes(df, ["v"], depth, range_rows)
    return fitted, [r["v"] for r in fitted.transform(df).orderBy("i").collect()]


@pytest.mark.parametrize("values,depth,want", [
    ([1, 2, 3, 4, 100], 2, ["00", "00", "01", "10", "11"]),
    ([5, 5, 5, 1], 5, [5.0, 5.0, 5.0, 1.0]),
    ([7, 7, 7], 5, [7.0, 7.0, 7.0]),
    ([1, None, 2, 3], 1, ["0", "nan", "0", "1"]),
])
def test_worked_examples(spark, values, depth, want):
    assert fit_codes(spark, values, depth)[1] == want


@pytest.mark.parametrize("seed,range_rows", [(1, None), (2, 40), (3, 7)])
def test_random_columns_match_recursion(spark, seed, range_rows):
    rng = random.Random(seed)
    values = [rng.choice([None, rng.randint(-5, 5), rng.gauss(0, 1), 0.0, -0.0]) for _ in range(700)]
    assert fit_codes(spark, values, 5, range_rows)[1] == brute(values, 5)


@pytest.mark.parametrize("values,depth,range_rows", [
    ([1, 2, 2, 3, 5, 8, 13, 21, 21], -1, None), ([1, 2, 2, 3, 5, 8, 13, 21, 21, None, -0.0, 0.0], -1, 2), ([7, 7, 7], -1, None), ([None], -1, None),
    ([2.0 ** k for k in range(60)] * 2 + [None], -1, 10), ([5, 5, 5, 1], -1, None), (list(range(500)), -1, 30), (list(range(600)), 13, None)])
def test_trees_of_any_depth(spark, values, depth, range_rows):
    fitted, got = fit_codes(spark, values, depth, range_rows)
    want = brute(values, depth)
    assert isinstance(fitted, MedianTree) and got == (want if fitted.splits("v") else [None if v is None else float(v) for v in values])
    assert fitted.splits("v") == (want is not None and want != ["nan"] * len(want))
    again = stored_codes(fitted.table(spark))
    assert isinstance(again, MedianTree) and again.splits("v") == fitted.splits("v")


@pytest.mark.parametrize("range_rows,most", [(None, 4), (150, 13)])
def test_levels_follow_what_one_task_cannot_hold(spark, monkeypatch, range_rows, most):
    """1,000 values need eleven levels; those of at most ``range_rows`` values are finished at once."""
    seen = []
    monkeypatch.setattr(discretize, "Written", lambda df, make=discretize.Written: seen.append(make(df)) or seen[-1])
    tree = MedianTree.fit(spark.range(1000).select(F.col("id").cast("double").alias("v")), ["v"], -1, range_rows)
    assert len(seen) <= most and tree.nodes.count() == 1999


def test_a_tree_codes_new_values_like_a_small_one(spark):
    """Values between and beyond the fitted ones; several columns, a leaf root and a null among them."""
    rng = random.Random(8)
    df = spark.createDataFrame([(float(rng.randint(0, 60)), rng.gauss(0, 1), 4.0, None) for _ in range(300)], "a double, b double, c double, d double")
    new = spark.createDataFrame([(rng.uniform(-9, 70), rng.gauss(0, 2), None if rng.random() < 0.1 else 5.0, 1.0) for _ in range(200)]
                                + [(float("nan"), float("inf"), -float("inf"), None)], "a double, b double, c double, d double")
    small, tree = MedianCodes.fit(df, ["a", "b", "c", "d"], 9), MedianTree.fit(df, ["a", "b", "c", "d"], 9, 25)
    assert [tree.splits(c) for c in "abcd"] == [small.splits(c) for c in "abcd"] == [True, True, False, False]
    assert sorted(map(repr, tree.transform(new).collect())) == sorted(map(repr, small.transform(new).collect()))
    with pytest.raises(ValueError, match="MedianTree"):
        MedianCodes.fit(df, ["a"], -1)
    nodes = {(r["column"], r["path"]): r["threshold"] for r in tree.table(spark).collect()}
    assert nodes == {(c, p): t for c, own in small.nodes.items() for p, t in own.items()}


def test_small_codes_reload(spark):
    fitted, _ = fit_codes(spark, [1, 2, 2, 3, 5, 8, 13, 21, 21], 5)
    assert stored_codes(fitted.table(spark)).nodes == fitted.nodes


def test_codes_are_monotone_and_at_most_two_to_the_depth(spark):
    rng = random.Random(5)
    values = sorted(rng.lognormvariate(0, 2) for _ in range(2000))
    _, got = fit_codes(spark, values, 5)
    assert got == sorted(got) and len(set(got)) <= 32


@pytest.mark.parametrize("range_rows", [4, None])
def test_ranks(spark, range_rows):
    rng = random.Random(9)
    values = [rng.randint(0, 40) for _ in range(500)] + [1e300, -1e300]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    with RankedColumns(df, ["v"], range_rows) as ranked:
        found = ranked.at({"v": set(range(len(values)))})["v"]
    ordered = sorted(values)
    assert [found[i].value for i in range(len(values))] == ordered
    assert all(ordered[f.below] == f.value == ordered[f.upto - 1] and f.below <= i < f.upto for i, f in found.items())


@pytest.mark.parametrize("range_rows", [None, 30, 7])
def test_scans_in_order(spark, range_rows):
    """Also where the ranges are so many that their summaries are cut into ranges themselves."""
    rng = random.Random(4)
    rows = [(f"k{i}" if i else None, rng.randint(0, 9), rng.choice([None, None, rng.randint(1, 5)])) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b int, n int").repartition(7)
    sums = {(r["a"], r["b"]): r["end"] for r in running_total(df, ["a", "b"], "n", "end", range_rows).collect()}
    lasts = {(r["a"], r["b"]): r["was"] for r in carried_forward(df, ["a", "b"], "n", "was", range_rows).collect()}
    total = last = None
    for a, b, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if n is not None:
            total, last = (total or 0) + n, n
        assert (sums[(a, b)] or 0, lasts[(a, b)]) == (total or 0, last)


def test_no_window_holds_many_rows(spark, monkeypatch):
    """The number of ranges follows the row count; no range holds more than some of its share, and no summary window either."""
    seen = []
    monkeypatch.setattr(cumulative, "Written", lambda df, make=cumulative.Written: seen.append(make(df)) or seen[-1])
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.lit(1).alias("n"))
    out = running_total(df, ["k"], "n", "end", 100)
    assert out.agg(F.max("end")).first()[0] == 20_000
    sizes = [one.table.groupBy("__range").count().agg(F.max("count"), F.count("*")).first() for one in seen]
    assert len(sizes) == 2 and sizes[0][1] > 150 and all(most <= 300 for most, _ in sizes)
    assert out._jdf.queryExecution().executedPlan().toString().count("SinglePartition") <= 1


@pytest.mark.parametrize("name", ["run_ranges", "column_vocabulary", "quantile_bins", "apply_bins", "median_codes", "median_codes_unlimited"])
def test_queries_with_tiny_ranges(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(cumulative, "RANGE_ROWS", 97)
    got = entry.queries()[name](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("values,n", [([0.0, 5.0, 10.0], 2), ([3.0, 3.0, 3.0], 4), ([0.0, 0.0], 3),
                                      (list(np.random.default_rng(1).normal(size=300)), 7)])
def test_uniform_bins_match_pandas(spark, values, n):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    fitted = BinEdges.uniform(df, ["v"], n)
    codes, edges = pd.cut(pd.Series(values), bins=n, retbins=True, labels=False, duplicates="drop")
    assert [r["v"] for r in fitted.transform(df).orderBy("i").collect()] == codes.tolist()
    assert np.allclose(fitted.edges["v"], edges)


@pytest.mark.parametrize("values,n", [([1.0, 1.0, 1.0, 2.0, 3.0], 4), (list(np.random.default_rng(2).integers(0, 20, 200) / 1.0), 6),
                                      (list(np.random.default_rng(3).normal(size=301)), 8)])
def test_quantile_bins_match_pandas(spark, values, n):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    fitted = BinEdges.quantile(df, ["v"], n, range_rows=20)
    codes, edges = pd.qcut(pd.Series(values), q=n, retbins=True, labels=False, duplicates="drop")
    assert [r["v"] for r in fitted.transform(df).orderBy("i").collect()] == codes.tolist()
    assert np.allclose(fitted.edges["v"], edges)


def test_stored_edges_on_new_data(spark):
    edges = BinEdges({"v": [0.0, 5.0, 10.0]}, False)
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (5.0,), (7.0,), (11.0,), (None,)], "v double")
    assert [r["v"] for r in edges.transform(df, fitted=False).collect()] == [0, 0, 0, 0, 1, 0, 0]
    child = df.withColumnRenamed("v", "mean_v").select(edges.applied("mean_v", parent="v").alias("c"))
    assert [r["c"] for r in child.collect()] == [0, 0, 0, 0, 1, 0, 0]
    assert BinEdges.from_table(edges.table(spark), False).edges == edges.edges
