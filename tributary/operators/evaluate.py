"""Quality measures over tables of scored label positions.

``scores`` has one row per label position: the sequence key, ``pos``, ``col_id``, the target
value and one probability per class of the column, in class order. Class tables are as small as
the vocabulary; everything of event size is grouped with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.functions.columns import bound, mapped, quoted
from tributary.functions.local import BROADCAST_ROWS, hinted, local_table

CLASS_SCHEMA = "col_id int, class_ix int, value string, id int, group_ix int"
GROUP_SCHEMA = "col_id int, value string, group_ix int"
# Parts of metric names that are logged.
LOGGED = ["batches", "rows", "epoch_time", "total_elapsed_time", "step_avg_time", "loss", "accuracy", "auc", "f1"]
# Fixed value: the instruction of the prompt data set.
SYSTEM_PROMPT = (
    "You are a helpful AI assistant that is good at analyzing sequential tabular data.  "
    "The user will give you tabular data in the form '<column name>:<value>' with '[ROW]' indicating the end of a row.  "
    "You will be given the next column name and are tasked with predicting the corresponding value. "
    "Please only respond with the next value. ")


def class_order(vocabulary: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Classes of each column in id order; ``groups`` (col_id, value, group_ix) consolidates them.

    The window is over the vocabulary, which has a fixed maximum size.
    """
    ix = (F.row_number().over(W.partitionBy("col_id").orderBy("id")) - 1).cast("int")
    classes = vocabulary.where(F.col("col_id").isNotNull()).select("col_id", ix.alias("class_ix"), "value", "id")
    if groups is None:
        return classes.withColumn("group_ix", F.lit(None).cast("int"))
    return classes.join(hinted(groups), ["col_id", "value"], "left").select(
        "col_id", "class_ix", "value", "id", "group_ix")


def class_groups(spark: SparkSession, consolidate: dict[str, dict[str, int]], col_ids: dict[str, int]) -> DataFrame:
    """(col_id, value, group_ix) of a data set's consolidation map {column: {value: group}}."""
    return local_table(spark, [(col_ids[c], v, g) for c, own in consolidate.items() for v, g in own.items()], GROUP_SCHEMA)


def group_mismatches(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(col_id, value, problem): classes of a consolidated column without a group, and groups of values that are no class."""
    ours = classes.join(hinted(groups.select("col_id").distinct()), "col_id", "left_semi").select("col_id", "value")
    lacking = ours.join(hinted(groups), ["col_id", "value"], "left_anti").withColumn("problem", F.lit("no group"))
    unknown = groups.select("col_id", "value").join(ours, ["col_id", "value"], "left_anti").withColumn("problem", F.lit("no class"))
    return lacking.unionByName(unknown)


def aligned_targets(seqs: DataFrame, key: list[str], label: int, ids: str = "input_ids",
                    mask: str = "mask") -> DataFrame:
    """Label positions of each sequence with the position whose output predicts them.

    The output at ``pos`` predicts the token at ``pos + 1``.
    """
    cells = F.filter(F.transform(quoted(mask), lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
                     lambda c: c["m"] == label)
    return (seqs.select(*map(quoted, key), F.explode(cells).alias("c"), quoted(ids).alias("__ids"))
            # The column id comes from the mask: as a literal it would turn later joins on it into loops.
            .select(*map(quoted, key), (F.col("c.i") - 1).alias("pos"), F.col("c.m").alias("col_id"),
                    F.element_at("__ids", F.col("c.i") + 1).alias("target_id")))


def softmax(own: Column) -> Column:
    """Probabilities of an array of logits."""
    powers = lambda o, top: F.transform(o, lambda x: F.exp(x - top))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    shares = lambda p: bound(total(p), lambda t: F.transform(p, lambda x: x / t))
    return bound(own, lambda o: bound(F.array_max(o), lambda top: bound(powers(o, top), shares)))


def restricted_softmax(logits: Column, class_ids: Column) -> Column:
    """Probabilities over the classes of one column only; ``logits`` is indexed by token id."""
    return softmax(F.transform(class_ids, lambda i: F.element_at(logits, i + 1)))


def class_index(class_ids: Column, target_id: Column) -> Column:
    """Position of the target in the class list, -1 when it is not a class of the column."""
    return (F.array_position(class_ids, target_id) - 1).cast("int")


def softmax_scores(targets: DataFrame, logits: DataFrame, classes: DataFrame, key: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join logits to aligned targets and score them over the classes of their column.

    Class lists of ``rows`` classes together are broadcast as one array per column. Larger ones are not: logits are spread by token,
    meet their class in a join, and each label position gathers its own classes, which its result holds anyway.
    """
    joined = targets.join(logits, [*key, "pos"])
    if classes.limit(rows + 1).count() <= rows:
        lists = classes.groupBy("col_id").agg(F.array_sort(F.collect_list(F.struct("class_ix", "id"))).alias("__c"))
        joined = joined.join(F.broadcast(lists), "col_id").withColumn("__ids", F.col("__c.id"))
        return joined.select(*map(quoted, key), "pos", "col_id",
                             class_index(F.col("__ids"), F.col("target_id")).alias("target_ix"),
                             restricted_softmax(F.col("logits"), F.col("__ids")).alias("probs"))
    at = [*map(quoted, key), F.col("pos"), F.col("col_id")]
    spread = joined.select(*at, "target_id", F.posexplode("logits").alias("id", "__x"))
    own = spread.join(classes.select("col_id", "id", "class_ix"), ["col_id", "id"]).groupBy(*at).agg(
        F.array_sort(F.collect_list(F.struct("class_ix", "__x"))).alias("__own"),
        F.coalesce(F.max(F.when(F.col("id") == F.col("target_id"), F.col("class_ix"))), F.lit(-1)).alias("target_ix"))
    return own.select(*map(quoted, key), "pos", "col_id", "target_ix", softmax(F.col("__own.__x")).alias("probs"))


def probability_violations(scores: DataFrame, tolerance: float = 1e-3, probs: str = "probs") -> DataFrame:
    """Rows whose probabilities miss 1 by more than the tolerance, with their ``total``.

    A generator of one row or none, not a filter: a filter would be pushed below whatever made the scores and make them a second time.
    """
    summed = scores.withColumn("__total", F.aggregate(quoted(probs), F.lit(0.0), lambda a, x: a + x))
    loose = F.when(F.abs(F.col("__total") - 1) > tolerance, F.array("__total"))
    return summed.select(*[quoted(c) for c in scores.columns if c != "total"], F.explode(loose).alias("total"))


def with_class(scores: DataFrame, classes: DataFrame, target: str = "target") -> DataFrame:
    """Add the class index and consolidated group of the target; -1 for values that are no class."""
    side = classes.select(F.col("col_id").alias("__c"), F.col("value").alias("__v"), "class_ix", "group_ix")
    joined = scores.join(hinted(side), (F.col("col_id") == F.col("__c")) & (quoted(target) == F.col("__v")), "left")
    return joined.drop("__c", "__v").withColumns(
        {"class_ix": F.coalesce("class_ix", F.lit(-1)), "group_ix": F.coalesce("group_ix", F.lit(-1))})


def group_probabilities(probs: Column, groups: list[int]) -> Column:
    """Sum class probabilities within groups; ``groups[i]`` is the group of class ``i``."""
    out = []
    for g in sorted(set(groups)):
        members = [F.element_at(probs, i + 1) for i, h in enumerate(groups) if h == g]
        total = members[0]
        for m in members[1:]:
            total = total + m
        out.append(total)
    return F.array(*out)


def predicted_class(probs: Column) -> Column:
    """Most likely class; the lowest index wins a tie."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def metric_variants(scores: DataFrame, key: list[str], groups: list[int] | None = None) -> DataFrame:
    """(variant, target_ix, pred_ix, probs) rows for all labels, the last label of a sequence,
    and both again over consolidated classes.

    A sequence has at most as many labels as events, so the window group is small. Rows whose
    target is no class of the column are kept with index -1; see ``known_targets``.
    """
    last = F.col("pos") == F.max("pos").over(W.partitionBy(*map(quoted, key), "col_id"))
    option = lambda name, target, probs: F.struct(
        F.lit(name).alias("variant"), target.alias("target_ix"), probs.alias("probs"))
    probs = F.col("probs")
    options = [option("", F.col("class_ix"), probs), F.when(F.col("__last"), option("_last", F.col("class_ix"), probs))]
    if groups and len(set(groups)) > 1:
        grouped = group_probabilities(probs, groups)
        order = {g: i for i, g in enumerate(sorted(set(groups)))}
        target = F.coalesce(mapped(F.col("group_ix"), order), F.lit(-1)).cast("int")
        options += [option("_consolidated", target, grouped),
                    F.when(F.col("__last"), option("_last_consolidated", target, grouped))]
    flagged = scores.withColumn("__last", last)
    return (flagged.select(F.explode(F.array_compact(F.array(*options))).alias("o"))
            .select("o.variant", "o.target_ix", predicted_class(F.col("o.probs")).alias("pred_ix"), "o.probs"))


def known_targets(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("target_ix") >= 0)


def unknown_targets(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("target_ix") < 0).groupBy("variant").agg(F.count(F.lit(1)).alias("dropped"))


def accuracy(variants: DataFrame, by: list[str] = ("variant",)) -> DataFrame:
    hit = (F.col("pred_ix") == F.col("target_ix")).cast("double")
    return variants.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


# Steps per power of e in the score bins and the smallest probability they resolve.
_BIN_STEPS = 4096
_BIN_FLOOR = 1e-15


def score_bin(p: Column) -> Column:
    """Monotone bin of a probability, fine near 0 and 1 where model scores pile up."""
    low = F.floor(F.ln(F.greatest(p, F.lit(_BIN_FLOOR))) * _BIN_STEPS)
    high = -F.floor(F.ln(F.greatest(1 - p, F.lit(_BIN_FLOOR))) * _BIN_STEPS)
    return F.when(p < 0.5, low).otherwise(high).cast("int")


def _ranked(lines: DataFrame, by: list[str], sides: dict[str, Column]) -> DataFrame:
    """Exact one-vs-rest AUC per ``by``, class and side out of lines (by, class_ix, p, hit); ties count half.

    ``sides`` names conditions on the lines; each is a pair of counters, so rows that several sides count are ranked once. Scores
    are counted per distinct value, then ranked inside score bins only. Pairs that cross bins follow from bin totals, of
    which there are at most some 283,000 per class. Classes without positives or without negatives yield null.
    """
    key = [*by, "class_ix"]
    ix, hit = range(len(sides)), F.col("hit")
    n = lambda cond: F.sum(F.when(cond, F.lit(1)).otherwise(0).cast("bigint"))
    flags = list(sides.values())
    counts = lines.groupBy(*key, score_bin(F.col("p")).alias("bin"), "p").agg(
        *[n(flags[i] & hit).alias(f"pos{i}") for i in ix], *[n(flags[i] & ~hit).alias(f"neg{i}") for i in ix])
    above = W.partitionBy(*key, "bin").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, -1)
    higher = W.partitionBy(*key).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    # As doubles: a product of two counts can pass the range of a bigint.
    before = lambda i, w: F.coalesce(F.sum(f"pos{i}").over(w), F.lit(0))
    neg = lambda i: F.col(f"neg{i}").cast("double")
    counts = counts.select("*", *[(neg(i) * (before(i, above) + F.col(f"pos{i}") / 2)).alias(f"within{i}") for i in ix])
    bins = counts.groupBy(*key, "bin").agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in ix for c in ("pos", "neg", "within")])
    bins = bins.select("*", *[(F.col(f"within{i}") + neg(i) * before(i, higher)).alias(f"pairs{i}") for i in ix])
    whole = bins.groupBy(*key).agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in ix for c in ("pos", "neg", "pairs")])
    total = lambda i: F.col(f"pos{i}").cast("double") * F.col(f"neg{i}").cast("double")
    found = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"pos{i}").alias("positives"), F.col(f"neg{i}").alias("negatives"),
                               F.when(total(i) > 0, F.col(f"pairs{i}") / total(i)).alias("auc")) for i, s in enumerate(sides)])
    return whole.select(*key, F.explode(found).alias("s")).where("s.positives + s.negatives > 0").select(*key, "s.*")


def auc_per_class(variants: DataFrame) -> DataFrame:
    """AUC per (variant, class) of rows that are expanded already; see ``metric_variants``."""
    lines = variants.select("variant", "target_ix", F.posexplode("probs").alias("class_ix", "p"))
    return _ranked(lines.withColumn("hit", F.col("target_ix") == F.col("class_ix")), ["variant"], {"": F.lit(True)}).drop("side")


def scores_auc(scores: DataFrame, key: list[str], groups: list[int] | None = None) -> DataFrame:
    """AUC per (variant, class) straight from the scores: every row is spread once, over its classes and its groups, and the variants
    of all labels and of last labels are counters of the same lines. Targets that are no class are left out."""
    last = F.col("pos") == F.max("pos").over(W.partitionBy(*map(quoted, key), "col_id"))
    line = lambda kind, target: lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("class_ix"), p.alias("p"), (target == i).alias("hit"))
    known = lambda target, kind, probs: F.when(target >= 0, F.transform(probs, line(kind, target)))
    parts = [known(F.col("class_ix"), "", F.col("probs"))]
    if groups and len(set(groups)) > 1:
        order = {g: i for i, g in enumerate(sorted(set(groups)))}
        target = F.coalesce(mapped(F.col("group_ix"), order), F.lit(-1)).cast("int")
        parts.append(known(target, "_consolidated", group_probabilities(F.col("probs"), groups)))
    spread = F.flatten(F.array_compact(F.array(*parts)))
    lines = scores.withColumn("__last", last).select("__last", F.explode(spread).alias("l")).select("__last", "l.*")
    found = _ranked(lines, ["kind"], {"": F.lit(True), "_last": F.col("__last")})
    return found.select(F.concat("side", "kind").alias("variant"), "class_ix", "positives", "negatives", "auc")


def macro_auc(per_class: DataFrame) -> DataFrame:
    """Macro mean over the classes that have an AUC."""
    return per_class.groupBy("variant").agg(F.avg("auc").alias("auc"))


def auc(variants: DataFrame) -> DataFrame:
    return macro_auc(auc_per_class(variants))


def class_counts(variants: DataFrame) -> DataFrame:
    """True and false positives and false negatives per (variant, class)."""
    pairs = variants.groupBy("variant", "target_ix", "pred_ix").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("target_ix").alias("class_ix"), F.lit("t").alias("side")),
                    F.struct(F.col("pred_ix").alias("class_ix"), F.lit("p").alias("side")))
    lines = pairs.select("variant", "n", (F.col("target_ix") == F.col("pred_ix")).alias("same"), F.explode(sides).alias("s"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return lines.groupBy("variant", "s.class_ix").agg(
        total(F.col("same") & (F.col("s.side") == "t")).alias("tp"),
        total(~F.col("same") & (F.col("s.side") == "p")).alias("fp"),
        total(~F.col("same") & (F.col("s.side") == "t")).alias("fn"))


def f1(variants: DataFrame) -> DataFrame:
    """Micro, macro and weighted F1; classes neither predicted nor present are left out."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    score = 2 * tp / (2 * tp + fp + fn)
    counts = class_counts(variants).withColumn("f1", score)
    micro = 2 * F.sum(tp) / (2 * F.sum(tp) + F.sum(fp) + F.sum(fn))
    return counts.groupBy("variant").agg(
        micro.alias("f1_micro"), F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * (tp + fn)) / F.sum(tp + fn)).alias("f1_weighted"))


def binary_f1(variants: DataFrame) -> DataFrame:
    """F1 of class 1 for two-class variants; class 1 is predicted above one half."""
    two = variants.where(F.size("probs") == 2)
    says = F.element_at("probs", 2) > 0.5
    true = F.col("target_ix") == 1
    n = lambda cond: F.count(F.when(cond, 1))
    bottom = 2 * n(says & true) + n(says & ~true) + n(~says & true)
    return two.groupBy("variant").agg(
        F.when(bottom > 0, 2 * n(says & true) / bottom).otherwise(0.0).alias("f1_binary"))


def column_accuracy(scores: DataFrame, groups: dict[int, list[int]] | None = None) -> DataFrame:
    """Accuracy per predicted column; ``groups`` (by column, the group of each class) consolidates the classes of a column."""
    hit = predicted_class(F.col("probs")) == F.col("class_ix")
    for col_id, members in (groups or {}).items():
        order = {g: i for i, g in enumerate(sorted(set(members)))}
        target = F.coalesce(mapped(F.col("group_ix"), order), F.lit(-1)).cast("int")
        own = predicted_class(group_probabilities(F.col("probs"), members)) == target
        hit = F.when(F.col("col_id") == col_id, own).otherwise(hit)
    hit = hit.cast("double")
    return scores.groupBy("col_id").agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


def overall_accuracy(per_column: DataFrame) -> DataFrame:
    """Mean of the column accuracies, each column counting once."""
    return per_column.agg(F.avg("accuracy").alias("accuracy_overall"))


def with_overall(per_column: DataFrame) -> DataFrame:
    """Column accuracies and their mean, as column -1 without rows. One line holds all columns, so the scores behind them are read once;
    a union with the mean would read them again."""
    line = lambda c, n, a: F.struct(c.cast("int").alias("col_id"), n.cast("bigint").alias("rows"), a.alias("accuracy"))
    own = F.collect_list(line(F.col("col_id"), F.col("rows"), F.col("accuracy"))).alias("own")
    overall = F.array(line(F.lit(-1), F.lit(0), F.col("mean")))
    return (per_column.agg(own, F.avg("accuracy").alias("mean"))
            .select(F.explode(F.concat("own", overall)).alias("l")).select("l.*"))


def gathered_batches(batches: DataFrame, accuracies: list[str], rows: str = "rows", loss: str = "loss",
                     by: list[str] = ()) -> DataFrame:
    """Batch count, rows, mean batch loss and row-weighted accuracies."""
    n = quoted(rows)
    return batches.groupBy(*map(quoted, by)).agg(
        F.count(F.lit(1)).alias("batches"), F.sum(n).alias("rows"), F.avg(quoted(loss)).alias("loss"),
        *[(F.sum(quoted(a) * n) / F.sum(n)).alias(a) for a in accuracies])


def metric_row(metrics: DataFrame, settings: dict, previous: dict | None = None, training: bool = False,
               keep: list[str] | None = LOGGED) -> DataFrame:
    """Prefix metric names, keep the logged ones, add run settings.

    Settings of an earlier run come in as ``train_<name>`` for the names the current run has.
    """
    prefix = "train_" if training else "eval_"
    kept = [c for c in metrics.columns if keep is None or any(k in c for k in keep)]
    earlier = {f"train_{k}": v for k, v in (previous or {}).items() if k in settings}
    return metrics.select(*[quoted(c).alias(prefix + c) for c in kept],
                          *[F.lit(v).alias(k) for k, v in {**settings, **earlier}.items()])


def prompts(df: DataFrame, text: str = "text", exclude_labels: bool = False,
            replace_question: str | None = None, system: str = SYSTEM_PROMPT) -> DataFrame:
    """Turn a text sequence that ends in ``question:answer [ROW]`` into a chat prompt.

    Adds ``question``, ``answer`` and ``messages``, an array of (role, content). A text with fewer than two words has
    no question, one without a colon no answer; both are null then. An answer may hold colons.
    """
    words = F.split(F.trim(F.regexp_replace(quoted(text), r"\s+", " ")), " ")
    parts = F.split(F.try_element_at(F.col("__words"), F.lit(-2)), ":", 2)
    history = F.slice(F.col("__words"), F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0)))
    df = df.withColumn("__words", words).withColumns({"__parts": parts, "__history": history})
    df = df.withColumns({"question": F.get("__parts", F.lit(0)), "answer": F.get("__parts", F.lit(1))})
    if exclude_labels:
        df = df.withColumn("__history", bound(F.coalesce("question", F.lit("")), lambda q: F.filter(
            F.col("__history"), lambda w: (q == "") | ~F.startswith(w, q))))
    if replace_question is not None:
        df = df.withColumn("question", F.lit(replace_question))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit(system)), message("user", F.array_join("__history", " ")),
                       message("assistant", F.concat("question", F.lit(":"))))
    return df.withColumn("messages", messages).drop("__words", "__parts", "__history")


