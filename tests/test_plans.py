"""Physical plans: what must not be in them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tributary.operators.layout import EntityLayout, with_gap
from tributary.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_need_one_exchange_of_the_events(spark):
    text = plan(queries.sequences(spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SinglePartition" not in text.split("Subquery")[0]


def test_gaps_read_only_their_columns(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", F.minute("ts").alias("m"))
    text = plan(with_gap(events, EntityLayout(["user_id"], ["ts", "event_id"]), "m"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text


def test_filters_reach_the_scan(spark):
    text = plan(queries.equality_filter(spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text


@pytest.mark.parametrize("name", ["time_gaps", "entity_stats", "masked_last_event", "text_sequences", "wide_events", "accuracy_variants",
                                  "auc_ovr", "f1_scores", "change_points", "prompts", "softmax_scores", "entity_split", "quantile_bins", "median_codes"])
def test_no_single_task_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for word in ("SinglePartition", "Python", "ArrowEval", "CartesianProduct", "NestedLoop"):
        assert word not in text, word


def test_column_accuracy_reads_and_scores_the_events_once(spark):
    found = queries.column_accuracy(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Five classes and two flags, and for each column whether the true class is preferred.
    assert found.count("md5(") == 9
    assert plan(queries.column_accuracy(spark, SF)).count("events.parquet") == 1


def test_softmax_check_takes_one_digest_per_class(spark):
    found = queries.softmax_check(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Five classes and whether the true one is preferred, in the filter over all rows and for the rows it leaves.
    assert found.count("md5(") <= 2 * 6


def test_softmax_check_scores_a_row_once_in_generated_code(spark):
    found = queries.softmax_check(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Five classes and whether the true one is preferred: no filter below that makes the scores a second time, and none in a lambda.
    assert found.count("md5(") == 6
    assert not [line for line in found.splitlines() if "md5(" in line and "lambda" in line]


def test_scores_without_classes_are_empty_arrays_of_doubles(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a")], "user_id bigint, seq_idx int, pos bigint, target string")
    found = queries._with_hashed_probs(rows, 5, F.col("target"), [])
    assert dict(found.dtypes)["probs"] == "array<double>" and found.first()["probs"] == []
    assert found.where("user_id < 0").select(F.element_at("probs", 1)).collect() == []


def test_entry_and_names():
    own = {q.__name__ for q in queries.QUERIES}
    assert own <= set(entry.oracle_sql()) and own <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
