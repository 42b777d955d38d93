"""Quality measures against direct computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import evaluate as E


def scored(spark, n, classes, seed, digits=2, missing=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [round(rng.random(), digits) + 1e-3 for _ in range(classes)]
        target = rng.choice([c for c in range(classes) if c != missing])
        rows.append(("", target, [x / sum(w) for x in w]))
    df = spark.createDataFrame(rows, "variant string, target_ix int, probs array<double>")
    return rows, df.withColumn("pred_ix", E.predicted_class(F.col("probs")))


def brute_auc(rows, c):
    pos = [p[c] for _, t, p in rows if t == c]
    neg = [p[c] for _, t, p in rows if t != c]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_overall_accuracy_is_one_more_line(spark):
    table = spark.createDataFrame([(4, 10, 0.5), (5, 30, 0.25)], "col_id int, rows bigint, accuracy double")
    assert sorted(map(tuple, E.with_overall(table).collect())) == [(-1, 0, 0.375), (4, 10, 0.5), (5, 30, 0.25)]
    assert list(map(tuple, E.with_overall(table.limit(0)).collect())) == [(-1, 0, None)]


@pytest.mark.parametrize("classes,digits,missing", [(2, 1, None), (3, 2, None), (4, 3, 1)])
def test_auc(spark, classes, digits, missing):
    rows, df = scored(spark, 150, classes, classes, digits, missing)
    got = {r["class_ix"]: r["auc"] for r in E.auc_per_class(df).collect()}
    for c in range(classes):
        want = brute_auc(rows, c)
        assert got[c] is None if want is None else math.isclose(got[c], want, abs_tol=1e-12)
    known = [v for v in got.values() if v is not None]
    assert math.isclose(E.auc(df).first()["auc"], sum(known) / len(known))


def test_auc_with_scores_piled_up_at_the_ends(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        p = rng.choice([0.0, 1.0, 1e-18, 10 ** -rng.uniform(3, 14), 1 - 10 ** -rng.uniform(3, 14)])
        rows.append(("", rng.randint(0, 1), [1 - p, p]))
    df = spark.createDataFrame(rows, "variant string, target_ix int, probs array<double>")
    got = {r["class_ix"]: r["auc"] for r in E.auc_per_class(df).collect()}
    assert all(math.isclose(got[c], brute_auc(rows, c), abs_tol=1e-12) for c in (0, 1))


def test_score_bin_is_monotone(spark):
    values = sorted([0.0, 1.0, 0.5, 5e-324] + [random.Random(1).random() ** k for k in range(1, 60)] + [1 - 2.0 ** -k for k in range(1, 53)])
    df = spark.createDataFrame([(v,) for v in values], "p double")
    bins = [r[0] for r in df.orderBy("p").select(E.score_bin(F.col("p"))).collect()]
    assert bins == sorted(bins)


def test_f1(spark):
    rows, df = scored(spark, 80, 4, 5, missing=3)
    pred = [max(range(4), key=lambda c: (p[c], -c)) for _, _, p in rows]
    true = [t for _, t, _ in rows]
    f1s, support = [], []
    for c in range(4):
        tp = sum(t == p == c for t, p in zip(true, pred))
        wrong = sum((t == c) != (p == c) for t, p in zip(true, pred))
        if tp or wrong:
            f1s.append(2 * tp / (2 * tp + wrong))
            support.append(true.count(c))
    got = E.f1(df).first()
    assert math.isclose(got["f1_micro"], sum(t == p for t, p in zip(true, pred)) / len(true))
    assert math.isclose(got["f1_macro"], sum(f1s) / len(f1s))
    assert math.isclose(got["f1_weighted"], sum(f * s for f, s in zip(f1s, support)) / sum(support))


def test_binary_f1_needs_more_than_one_half(spark):
    df = spark.createDataFrame([("", 1, [0.5, 0.5]), ("", 1, [0.4, 0.6]), ("", 0, [0.1, 0.9])],
                               "variant string, target_ix int, probs array<double>")
    assert E.binary_f1(df).first()["f1_binary"] == 0.5


def test_softmax_and_alignment(spark):
    seqs = spark.createDataFrame([("u", 0, [1, 7, 5, 8, 5, 2], [-1, 0, 1, 0, 1, -1])], "u string, s int, input_ids array<int>, mask array<int>")
    targets = E.aligned_targets(seqs, ["u", "s"], 0)
    assert [(r["pos"], r["target_id"]) for r in targets.orderBy("pos").collect()] == [(0, 7), (2, 8)]
    classes = spark.createDataFrame([(0, 0, "a", 7, None), (0, 1, "b", 9, None)], E.CLASS_SCHEMA)
    logits = spark.createDataFrame([("u", 0, p, [float(i) for i in range(10)]) for p in (0, 2)], "u string, s int, pos int, logits array<double>")
    rows = {r["pos"]: r for r in E.softmax_scores(targets, logits, classes, ["u", "s"]).collect()}
    assert rows[0]["target_ix"] == 0 and rows[2]["target_ix"] == -1
    assert math.isclose(rows[0]["probs"][1], math.exp(2) / (1 + math.exp(2)))
    assert E.probability_violations(spark.createDataFrame([([0.5, 0.4],), ([0.5, 0.5],)], "probs array<double>")).count() == 1


def test_variants_and_dropped_targets(spark):
    classes = spark.createDataFrame([(5, 0, "a", 1, 0), (5, 1, "b", 2, 1), (5, 2, "c", 3, 1)], E.CLASS_SCHEMA)
    df = spark.createDataFrame([("u", 1, 5, "a", [0.4, 0.3, 0.3]), ("u", 2, 5, "c", [0.4, 0.35, 0.25]), ("v", 1, 5, "zz", [1.0, 0.0, 0.0])],
                               "u string, pos int, col_id int, target string, probs array<double>")
    variants = E.metric_variants(E.with_class(df, classes), ["u"], [0, 1, 1])
    acc = {r["variant"]: (r["rows"], r["accuracy"]) for r in E.accuracy(E.known_targets(variants)).collect()}
    assert acc == {"": (2, 0.5), "_last": (1, 0.0), "_consolidated": (2, 0.5), "_last_consolidated": (1, 1.0)}
    assert {r["variant"]: r["dropped"] for r in E.unknown_targets(variants).collect()} == dict.fromkeys(acc, 1)


def test_class_order_with_groups(spark):
    vocab = spark.createDataFrame([("0_b", 9, 0, "b"), ("0_a", 5, 0, "a"), ("[PAD]", 0, None, None)], "token string, id int, col_id int, value string")
    groups = spark.createDataFrame([(0, "b", 1)], "col_id int, value string, group_ix int")
    assert [tuple(r) for r in E.class_order(vocab, groups).orderBy("class_ix").collect()] == [(0, 0, "a", 5, None), (0, 1, "b", 9, 1)]


def test_batches_and_run_row(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (3, 1.5, 0.0)], "rows bigint, loss double, accuracy double")
    out = E.gathered_batches(df, ["accuracy"])
    assert tuple(out.first()) == (2, 4, 1.0, 0.25)
    row = E.metric_row(out.withColumn("other", F.lit(1)), {"seed": 1, "name": "b"}, {"seed": 2, "lr": 0.1}, training=True).first().asDict()
    assert row == {"train_batches": 2, "train_rows": 4, "train_loss": 1.0, "train_accuracy": 0.25, "seed": 1, "name": "b", "train_seed": 2}


def test_prompts(spark):
    df = spark.createDataFrame([("y:1 x:2 [ROW]  y:3\nx:4 [ROW]",)], "text string")
    row = E.prompts(df).first()
    assert (row["question"], row["answer"]) == ("x", "4")
    assert [m["content"] for m in row["messages"]][1:] == ["y:1 x:2 [ROW] y:3", "x:"]
    row = E.prompts(df, exclude_labels=True, replace_question="the x").first()
    assert [m["content"] for m in row["messages"]][1:] == ["y:1 [ROW] y:3", "the x:"] and row["answer"] == "4"


def test_class_lists_too_large_to_broadcast(spark):
    """The same scores by both ways; a target that is no class, a column without positions, extreme logits."""
    classes = spark.createDataFrame([(0, 0, "a", 5, 0), (0, 1, "b", 2, 0), (0, 2, "c", 7, 0), (1, 0, "x", 1, 0), (9, 0, "z", 0, 0)], E.CLASS_SCHEMA)
    targets = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 0, 3), (1, 2, 1, 1), (2, 0, 0, 7)], "k int, pos int, col_id int, target_id int")
    logits = spark.createDataFrame([(1, 0, [float(i) for i in range(8)]), (1, 1, [-800.0, 0.0, -900.0, 0.0, 0.0, 900.0, 0.0, 1.0]), (1, 2, [3.0] * 8), (2, 0, [900.0, 0.0, 0.0, 0.0, 0.0, -900.0, 0.0, -901.0])],
                                   "k int, pos int, logits array<double>")
    near, spread = (sorted(map(tuple, E.softmax_scores(targets, logits, classes, ["k"], rows).collect())) for rows in (10, 3))
    assert near == spread and [r[3] for r in near] == [1, -1, 0, 2]
    for r in near:
        own = {0: [5, 2, 7], 1: [1]}[r[2]]
        x = logits.where(f"k = {r[0]} AND pos = {r[1]}").first()["logits"]
        powers = [math.exp(x[i] - max(x[j] for j in own)) for i in own]
        assert r[4] == pytest.approx([p / sum(powers) for p in powers])


def test_auc_of_scores_is_that_of_expanded_variants(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 9), i, 0, rng.choice([-1, 0, 1, 2]), None, [round(rng.random(), 1) for _ in range(3)]) for i in range(300)]
    rows = [(*r[:4], {-1: -1, 0: 0, 1: 4, 2: 4}[r[3]], r[5]) for r in rows]
    scores = spark.createDataFrame(rows, "s int, pos int, col_id int, class_ix int, group_ix int, probs array<double>")
    ours = {(r.variant, r.class_ix): tuple(r)[2:] for r in E.scores_auc(scores, ["s"], [0, 4, 4]).collect()}
    plain = {(r.variant, r.class_ix): tuple(r)[2:] for r in E.auc_per_class(E.known_targets(E.metric_variants(scores, ["s"], [0, 4, 4]))).collect()}
    assert ours == plain and len(ours) == 10
    plan = E.scores_auc(scores, ["s"], [0, 4, 4])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(flatten") == 1


def test_groups_must_cover_the_classes(spark):
    classes = spark.createDataFrame([(2, i, v, i, None) for i, v in enumerate("abc")] + [(3, 0, "x", 9, None)], E.CLASS_SCHEMA)
    groups = E.class_groups(spark, {"label": {"a": 0, "b": 1, "z": 1}}, {"label": 2, "other": 3})
    assert sorted(map(tuple, E.group_mismatches(classes, groups).collect())) == [(2, "c", "no group"), (2, "z", "no class")]
    assert E.group_mismatches(classes, E.class_groups(spark, {"label": {v: 0 for v in "abc"}}, {"label": 2})).isEmpty()
