"""Rows and sizes that once raised or gave wrong values."""

import math
import time

import pytest
from pyspark.sql import functions as F

from tributary.functions import columns as C
from tributary.operators import evaluate, stats, tokens
from tributary.plans import queries


def test_constant_column_scales_to_nan(spark):
    rows = stats.zscore(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"]).collect()
    assert all(math.isnan(r["x"]) for r in rows)


@pytest.mark.parametrize("text, want", [("12:30", "2020-02-03 12:30:00"), ("0630", None), ("ab:cd", None), (None, None), ("25:00", None)])
def test_clock_times(spark, text, want):
    df = spark.createDataFrame([(2020, 2, 3, text)], "y int, m int, d int, t string")
    got = df.select(C.clock_timestamp(F.col("y"), F.col("m"), F.col("d"), F.col("t")).cast("string").alias("ts")).first()["ts"]
    assert got == want


@pytest.mark.parametrize("text, question, answer", [
    ("a:1 b:2 [ROW]", "b", "2"), ("t:12:30 [ROW]", "t", "12:30"), ("plain [ROW]", "plain", None), ("alone", None, None), ("", None, None), (None, None, None)])
def test_prompts(spark, text, question, answer):
    row = evaluate.prompts(spark.createDataFrame([(text,)], "text string"), exclude_labels=True).first()
    assert (row["question"], row["answer"]) == (question, answer)


@pytest.mark.parametrize("x, want", [
    (12345678.5, "12345678.5"), (0.0005, "0.0005"), (0.00012345678901234567, "0.00012345678901234567"), (1e7, "10000000.0"), (1.5, "1.5"), (0.0, "0.0"),
    (1e15, "1000000000000000.0"), (1e16, "1e+16"), (1.25e-5, "1.25e-05"), (-3e-120, "-3e-120"), (float("nan"), "nan"), (float("-inf"), "-inf"), (None, None)])
def test_number_text(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(tokens.number_text(F.col("x")).alias("t")).first()["t"]
    assert got == want and (x is None or want == repr(x))


def test_auc_of_many_rows(spark):
    big = 10**10
    counts = spark.createDataFrame([("", 0, 0, 0.5, big, big)], "variant string, class_ix int, bin int, p double, pos bigint, neg bigint")
    assert counts.select((F.col("neg").cast("double") * F.col("pos")).alias("n")).first()["n"] == float(big) ** 2


def test_softmax_over_many_classes(spark):
    n = 2_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double") / 100).alias("logits"), F.sequence(F.lit(0), F.lit(n - 1)).alias("ids"))
    probs = evaluate.restricted_softmax(F.col("logits"), F.col("ids"))
    df.select(probs.alias("p")).collect()
    start = time.perf_counter()
    p = df.select(probs.alias("p")).first()["p"]
    assert abs(sum(p) - 1) < 1e-9 and len(p) == n and time.perf_counter() - start < 5


def test_masked_ids_lie_in_the_vocabulary(spark):
    sf = "/root/testdata/sf0.001"
    size = queries._encoder(spark, sf).vocabulary.count()
    ids = queries.masked_tokens(spark, sf).select(F.explode(F.split("input_ids", " ").cast("array<int>")).alias("i")).agg(F.max("i"), F.min("i")).first()
    assert 0 <= ids[1] and ids[0] < size
