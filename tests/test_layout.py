"""Order operators: a cut hot entity gives the same result as a plain window."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import layout as L
from tributary.operators.layout import EntityLayout


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        user = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None])
        # Bursts: many events share a minute, some have no time at all.
        minute = None if rng.random() < 0.01 else int(rng.choice([rng.randint(0, 50), rng.randint(0, 100000)]))
        rows.append((user, minute, i, rng.choice(["a", "b"])))
    return spark.createDataFrame(rows, "u int, m bigint, id int, v string").repartition(5).cache()


@pytest.fixture(scope="module")
def layouts(events):
    plain = EntityLayout.fit(events, ["u"], ["m", "id"])
    cut = EntityLayout.fit(events, ["u"], ["m", "id"], split_rows=500)
    assert not plain.is_split and cut.is_split and cut.hot.count() >= 1
    return plain, cut


def rows(df):
    return sorted(map(repr, df.collect()))


def test_ordinals_gaps_and_last_flags(events, layouts):
    for build in (lambda l: l.number(events, "pos", {"was": "m", "w2": "v"}, "last", "prev"),
                  lambda l: L.with_gap(events, l, "m"), lambda l: L.mask_last_event(events, l, ["v"]),
                  lambda l: L.change_points(events, l, ["v"])):
        a, b = (rows(build(l)) for l in layouts)
        assert a == b


def test_cut_windows_never_hold_a_whole_hot_entity(events, layouts):
    cells = layouts[1]._with_cell(events.where("u = 1"), "left").groupBy("__cell").count()
    assert cells.agg(F.max("count")).first()[0] < events.where("u = 1").count() / 10


def test_against_brute_force(events, layouts):
    got = {(r["u"], r["id"]): r["total_minutes_from_last"] for r in L.with_gap(events, layouts[1], "m").collect()}
    per = {}
    for r in events.collect():
        per.setdefault(r["u"], []).append((r["m"] is not None, r["m"] or 0, r["id"], r["m"]))
    for u, rs in per.items():
        before = None
        for _, _, i, m in sorted(rs):
            want = m - before if m is not None and before is not None else 0
            assert got[(u, i)] == want
            before = m


def test_runs_are_merged_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "u string, t int")
    ranges = {r["u"]: (r["start"], r["end"]) for r in L.run_ranges(df, EntityLayout(["u"], ["t"])).collect()}
    assert ranges == {"a": (0, 2), "b": (2, 3)}


def test_change_points_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, None, "y"), (1, 3, "p", "y")], "u int, t int, a string, b string")
    got = {r["t"]: r["changed"] for r in L.change_points(df, EntityLayout(["u"], ["t"]), ["a", "b"]).collect()}
    assert got == {1: ["a", "b"], 2: ["b"], 3: ["a"]}


def shapes(rng, n=3000):
    """Rows of one hot entity by what they are ordered by: text, one shared time, few first values, nulls, a decimal and a date."""
    same = [(1, 7, None, i) for i in range(n)]
    cards = [(1, rng.choice([None, 3, 3, 3, 5]), str(rng.choice([None, rng.randint(0, 10000)])), i) for i in range(n)]
    words = [(1, None, rng.choice([None, "", "a", "zz", f"w{rng.randint(0, 10000)}"]), i) for i in range(n)]
    return {"same": (same, ["a", "id"]), "cards": (cards, ["a", "t", "id"]), "words": (words, ["t", "id"])}


@pytest.mark.parametrize("shape", ["same", "cards", "words"])
def test_any_order_cuts(spark, shape):
    """Cells stay small whatever the order columns are, and the result is that of a plain window."""
    rng = random.Random(6)
    rows, order = shapes(rng)[shape]
    df = spark.createDataFrame([*rows, (2, 1, "x", -1), (None, 1, "x", -2)], "u int, a int, t string, id int").repartition(4)
    plain, cut = EntityLayout(["u"], order), EntityLayout.fit(df, ["u"], order, split_rows=500, cell_rows=100)
    sizes = cut._with_cell(df, "inner").groupBy("__cell").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 400 and sizes[1] > 20
    a, b = (sorted(map(repr, l.number(df, "pos", {"was": "a", "w2": "t"}, "last", "prev").collect())) for l in (plain, cut))
    assert a == b


def test_cells_are_bounded_over_all_entities(spark, monkeypatch):
    """More hot entities than the driver lists, and fewer cells than they ask for."""
    monkeypatch.setattr(L, "MAX_HOT", 3)
    monkeypatch.setattr(L, "ALL_CELLS", 10)
    df = spark.range(2000).select((F.col("id") % 8).alias("u"), F.col("id").cast("string").alias("t"))
    plain, cut = EntityLayout(["u"], ["t"]), EntityLayout.fit(df, ["u"], ["t"], split_rows=100, cell_rows=5)
    assert cut.hot.agg(F.sum(F.size("__edges"))).first()[0] <= 18
    a, b = (sorted(map(repr, l.number(df, "pos", {"was": "t"}, "last").collect())) for l in (plain, cut))
    assert a == b
