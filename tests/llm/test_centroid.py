"""Centroid clusters over zone-mapped blocks."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from tributary.llm.centroid import DIMENSIONS, box_candidates, clustered, hilbert_keys, nearest, with_inertia

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(pairs, clusters, rounds):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in pairs
             if v is not None and len(v) == DIMENSIONS and all(x is not None and math.isfinite(x) and abs(x) < 131_072 for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)[:clusters]
    centroids = [v for _, v in first]
    if not centroids:
        return [], []
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((d(v, c), k) for k, c in enumerate(centroids)) for _, v in whole]
    for _ in range(rounds):
        best = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(whole, best, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i is None, i or 0, k, n) for (i, _), (n, k) in zip(whole, assign(), strict=True)), centroids


def vectors(seed, n, spread=1.0):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(DIMENSIONS)] for _ in range(5)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(middle)]) for i in range(n)]


ODD = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [math.nan] + [1.0] * 63), (7, [math.inf] + [1.0] * 63),
       (8, [2e5] + [0.0] * 63), (9, [0.0] * 64), (10, [0.0] * 64), (11, [-0.0004] * 64), (None, [0.5] * 64), (None, [0.5] * 64), (12, [1.0] * 64), (12, [1.0] * 64)]


@pytest.mark.parametrize("pairs,clusters,block", [(vectors(1, 300, 0.1), 8, 16), (vectors(2, 120), 8, 512), (ODD + vectors(3, 40), 8, 4), (ODD, 8, 4),
                                                  ([(i, [float(i % 3)] * 64) for i in range(90)], 8, 8), (vectors(4, 3), 8, 4)])
def test_rounds_like_plain_ones(spark, scratch, pairs, clusters, block):
    """Nulls, other lengths, values that are not finite or too large, ties, repeated rows, missing ids, fewer vectors than centroids."""
    table = spark.createDataFrame([(i, v, 0) for i, v in pairs], SCHEMA).repartition(3)
    found, centroids = clustered(table, scratch, clusters=clusters, rounds=4, block=block)
    want, ends = plain(pairs, clusters, 4)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()) == want and centroids == ends


def test_empty_tables_and_clashing_columns(spark, scratch):
    for rows in ([], ODD[:8], [(None, [1.0] * 64, 0)][:0]):
        found, centroids = clustered(spark.createDataFrame([(i, v, 0) for i, v, *_ in rows], SCHEMA), scratch)
        assert with_inertia(found, scratch).count() == 0 and centroids == []
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors(5, 30)], SCHEMA).withColumns({c: F.lit(1) for c in ["id", "v", "place", "n", "cluster"]})
    found, _ = clustered(table, scratch, rounds=1)
    rows = with_inertia(found, scratch).collect()
    assert len(rows) == 30 and {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    assert all(r.cluster_inertia == sum(x.distance for x in rows if x.cluster == r.cluster) for r in rows)


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    order = sorted(range(len(cells)), key=hilbert_keys(cells, bits).__getitem__)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all() and len(set(hilbert_keys(cells, bits))) == len(cells)


def test_boxes_keep_the_nearest_centroid_and_rule_others_out():
    r = np.random.default_rng(1)
    ruled_out = 0
    for _ in range(200):
        centroids = r.integers(-900, 900, (8, 6))
        v = r.integers(-900, 900, 6) + r.integers(-150, 150, (20, 6))
        among = box_candidates(v.min(0), v.max(0), centroids)
        best, _ = nearest(v, centroids, np.arange(8))
        assert set(best) <= set(among)
        ruled_out += 8 - len(among)
    assert ruled_out > 400


def test_query_like_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op13_centroid_clusters"](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(entry.oracle_sql()["op13_centroid_clusters"]).df()) is None and len(got)
