"""Run tables: latest runs, summaries, pivots, comparison with published numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import mapped, quoted
from tributary.functions.local import local_table

# The file name of a run's metrics and how the data sets are called in reports.
RUN_FILE = r"^table-(.+)(\d{4}-\d{2}-\d{2}-\d{2}-\d{2})-(train|eval)_stats\.csv"
RUN_TIME = "yyyy-MM-dd-HH-mm"
DATASET_NAMES = {
    "EVAL_pretrain_amazon_electronics": "Amazon Electronics",
    "EVAL_pretrain_amazon_movies": "Amazon Movies",
    "EVAL_pretrain_ibm": "Fraud Detection",
}
# Published AUC per method and data set.
PUBLISHED = [
    ("Fata-Trans", "Fraud Detection", 0.9992),
    ("Fata-Trans", "Amazon Electronics", 0.7206),
    ("Fata-Trans", "Amazon Movies", 0.8057),
    ("TabBERT", "Fraud Detection", 0.9985),
    ("TabBERT", "Amazon Electronics", 0.7098),
    ("TabBERT", "Amazon Movies", 0.7964),
    ("UniTTab", "Fraud Detection", 0.987),
]
REPORT_COLS = ["Dataset", "Method", "Value", "Std"]
RUN_COLUMNS = ["task_name", "experiment_name", "creation_time", "train_eval"]


def parse_run_files(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Task, experiment, time and phase out of a metrics file name; other names are dropped."""
    f = quoted(filename)
    head = F.regexp_extract(f, RUN_FILE, 1)
    parts = F.split(F.left(head, F.length(head) - 1), "_")
    rest = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "_")
    time = F.try_to_timestamp(F.regexp_extract(f, RUN_FILE, 2), F.lit(RUN_TIME)).cast("timestamp_ntz")
    return df.where(f.rlike(RUN_FILE)).select(
        "*", F.array_join(F.slice(parts, 1, 3), "_").alias("task_name"),
        F.when(F.length(rest) <= 1, F.lit("base")).otherwise(rest).alias("experiment_name"),
        time.alias("creation_time"), F.regexp_extract(f, RUN_FILE, 3).alias("train_eval"))


def keep_first(df: DataFrame, subset: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order. An aggregate, so a busy key is reduced map-side."""
    whole = F.struct(*map(quoted, df.columns))
    first = df.groupBy(*[quoted(c).alias(f"__k{i}") for i, c in enumerate(subset)]).agg(
        F.min_by(whole, F.struct(*order)).alias("__r"))
    return first.select(*[F.col("__r").getField(c).alias(c) for c in df.columns])


def latest_runs(runs: DataFrame, phase: str, keys: list[str] = ("task_name", "experiment_name"),
                time: str = "creation_time", filename: str = "filename") -> DataFrame:
    """The newest run of each group in one phase; the smaller file name wins a tie."""
    chosen = runs.where(F.col("train_eval") == phase)
    newest_first = -F.unix_timestamp(quoted(time))
    return keep_first(chosen, list(keys), [newest_first.alias("t"), quoted(filename)])


def experiment_of(name: Column) -> Column:
    """Parts after the third underscore, ``Base`` when there are none."""
    parts = F.split(name, "_")
    rest = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "_")
    return F.when(rest == "", F.lit("Base")).otherwise(rest)


def setup_key(randomize: Column, masking: Column) -> Column:
    return F.format_string("randomize=%s/mask=%s", randomize, masking)


def metric_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and count of each metric; rows with a null key are left out."""
    known = df
    for k in keys:
        known = known.where(quoted(k).isNotNull())
    aggs = []
    for m in metrics:
        v = quoted(m).try_cast("double")
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std"), F.count(v).alias(f"{m}_count")]
    return known.groupBy(*map(quoted, keys)).agg(*aggs)


def chosen_metric(df: DataFrame, dataset: str, word: str, when_in: str, otherwise: str,
                  out: str = "desired_metric") -> DataFrame:
    """Take one of two metrics by a word in the data set name, mean and deviation alike."""
    inside = quoted(dataset).contains(word)
    return df.withColumns({f"{out}_{s}": F.when(inside, quoted(f"{when_in}_{s}")).otherwise(quoted(f"{otherwise}_{s}"))
                           for s in ("mean", "std")})


def where_equal(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        df = df.where(quoted(name) == F.lit(value))
    return df


def metric_pivot(df: DataFrame, index: str, columns: str, values: list, metric: str) -> DataFrame:
    """One row per index value, one column per listed value; two rows in one cell are an error."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two rows for one pivot cell")).cast("double")).otherwise(
        F.max(quoted(metric)))
    return df.groupBy(quoted(index)).pivot(columns, values).agg(cell)


def published_results(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(d, m, v, 0.0) for m, d, v in PUBLISHED],
                                 "Dataset string, Method string, Value double, Std double")


def with_published(results: DataFrame) -> DataFrame:
    return results.select(*REPORT_COLS).unionByName(published_results(results.sparkSession))


def dataset_name(c: Column) -> Column:
    return mapped(c, DATASET_NAMES)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First rows of a sorted table, kept as a top-n so that nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)
