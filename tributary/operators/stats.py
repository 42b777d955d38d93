"""Entity statistics, table profiles and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.functions.columns import quoted
from tributary.schema import EventSchema
from tributary.sources.shared import Written


def _mode_counts(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Occurrences of each value of each column per key, pre-aggregated before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(i).alias("which"), quoted(c).alias("value"))
                      for i, c in enumerate(cols)])
    return (df.select(*map(quoted, keys), F.explode(pairs).alias("__p"))
            .select(*map(quoted, keys), "__p.which", "__p.value")
            .where(F.col("value").isNotNull())
            .groupBy(*map(quoted, keys), "which", "value").agg(F.count(F.lit(1)).alias("__n")))


def _most_frequent(i: int, amount: str) -> Column:
    """Most frequent value of one column; the smallest value wins a tie."""
    rank = F.when(F.col("which") == i, F.struct((-F.col(amount)).alias("n"), F.col("value").alias("v")))
    return F.min(rank).getField("v")


def _moments(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    v = quoted(amount)
    return df.groupBy(*map(quoted, keys)).agg(F.count(v).alias("__n"), F.avg(v).cast("double").alias("__mean"),
                                              F.coalesce(F.var_samp(v), F.lit(0.0)).alias("__var"))


def _entity_numbers(moments: DataFrame, keys: list[str], mean: str, std: str) -> DataFrame:
    """Mean and deviation per entity; a single value has no deviation."""
    return moments.select(*map(quoted, keys), F.col("__mean").alias(mean), F.when(F.col("__n") > 1, F.sqrt("__var")).alias(std))


def _whole_numbers(moments: DataFrame, mean: str, std: str) -> DataFrame:
    """Mean and deviation of the table from those of its entities: counts, means and squared deviations add up."""
    n, m, v = F.col("__n"), F.col("__mean"), F.col("__var")
    total = F.sum(n)
    centre = F.sum(n * m) / total
    spread = F.sum((n - 1) * v + n * m * m) - total * centre * centre
    filled = moments.where(n > 0)
    return filled.agg(centre.alias(mean), F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(total - 1, F.lit(0)))).alias(std))


def _tops(counts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return counts.groupBy(*map(quoted, keys)).agg(*[_most_frequent(i, "__n").alias(name) for i, name in enumerate(names)])


def entity_stats(df: DataFrame, keys: list[str], amount: str, modes: dict[str, str],
                 mean: str = "avg_dollar_amt", std: str = "std_dollar_amt") -> DataFrame:
    """Mean, sample deviation and most frequent values per entity.

    ``modes`` maps output names to columns. The modes are counted per (entity, value) first, so
    a busy entity is merged from partial counts, not buffered.
    """
    numeric = _entity_numbers(_moments(df, keys, amount), keys, mean, std)
    if not modes:
        return numeric
    return numeric.join(_tops(_mode_counts(df, keys, list(modes.values())), keys, list(modes)), keys, "left")


def _with_whole_modes(numbers: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """One row of figures with the most frequent values of the whole table."""
    merged = counts.groupBy("which", "value").agg(F.sum("__n").alias("__n"))
    fill = merged.agg(F.struct(*[_most_frequent(i, "__n").alias(name) for i, name in enumerate(names)]).alias("f")).scalar()
    return numbers.select("*", *[fill.getField(name).alias(name) for name in names])


def dataset_stats(df: DataFrame, amount: str, modes: dict[str, str],
                  mean: str = "avg_dollar_amt", std: str = "std_dollar_amt") -> DataFrame:
    """The same statistics over the whole table, one row."""
    whole = df.agg(F.avg(quoted(amount)).alias(mean), F.stddev_samp(quoted(amount)).alias(std))
    return _with_whole_modes(whole, _mode_counts(df, [], list(modes.values())), list(modes)) if modes else whole


def join_entity_stats(df: DataFrame, history: DataFrame, keys: list[str], amount: str,
                      modes: dict[str, str], mean: str = "avg_dollar_amt",
                      std: str = "std_dollar_amt") -> DataFrame:
    """Add the entity statistics of ``history``; gaps are filled with its table-wide values.

    Table-wide values are merged from the moments and value counts of the entities, so both come from the same two
    exchanges of ``history``; these are written to the shared folder once, and the one row of table-wide values is read from there. The
    join carries no broadcast hint: the entity table grows with the data, so adaptive
    execution broadcasts it only when its measured size allows and splits skewed partitions otherwise.
    """
    names = [mean, std, *modes]
    moments = Written(_moments(history, keys, amount)).table
    stats, whole = _entity_numbers(moments, keys, mean, std), _whole_numbers(moments, mean, std)
    if modes:
        counts = Written(_mode_counts(history, keys, list(modes.values()))).table
        stats = stats.join(_tops(counts, keys, list(modes)), keys, "left")
        whole = _with_whole_modes(whole, counts, list(modes))
    fill = whole.first()
    joined = df.join(stats, keys, "left")
    return joined.select(*[quoted(c) for c in df.columns], *[F.coalesce(quoted(n), F.lit(fill[n])).alias(n) for n in names])


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Rows, columns and distinct values per column, one row per column of the table.

    Nulls are not counted as a value.
    """
    cols = list(cols or df.columns)
    if approximate:
        wide = df.agg(F.count(F.lit(1)).alias("rows"),
                      *[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"))
                          for i, c in enumerate(cols)])
        return wide.select("rows", F.lit(len(df.columns)).alias("columns"), F.explode(pairs).alias("p")).select(
            "p.column", "p.n_distinct", "rows", "columns")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols])
    # One shuffle of pre-aggregated (column, value) pairs, whatever the number of columns.
    values = (df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return (values.groupBy("column")
            .agg(F.count("value").alias("n_distinct"), F.sum("n").alias("rows"))
            .withColumn("columns", F.lit(len(df.columns))))


def profile(df: DataFrame, schema: EventSchema, bucket_depth: int = -1) -> DataFrame:
    """Long table (column, role, stat, value): distinct values, and moments of numeric columns.

    Distinct counts include null as a value, as a list of unique values does.
    """
    roles = [("index", schema.index), ("categorical", schema.categorical),
             ("binary", schema.binary), ("label", schema.label)]
    counted = list(dict.fromkeys(c for _, cols in roles for c in cols))
    out = []
    if counted:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("v")) for c in counted])
        distinct = (df.select(F.explode(pairs).alias("p")).select("p.column", "p.v")
                    .groupBy("column", "v").agg(F.count(F.lit(1)))
                    .groupBy("column").agg(F.count(F.lit(1)).cast("double").alias("value")))
        tags = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(role).alias("role"))
                         for role, cols in roles for c in cols])
        out.append(distinct.select("column", F.explode(F.filter(tags, lambda t: t["c"] == F.col("column"))).alias("t"),
                                   "value")
                   .select("column", F.col("t.role").alias("role"), F.lit("distinct").alias("stat"), "value"))
    if schema.numeric:
        stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        cells = []
        aggs = []
        for i, c in enumerate(schema.numeric):
            x = F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double"))
            for s, f in stats.items():
                aggs.append(f(x).alias(f"{s}{i}"))
                cells.append(F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"{s}{i}").alias("value")))
            if bucket_depth > 0:
                cells.append(F.struct(F.lit(c).alias("column"), F.lit("buckets").alias("stat"),
                                      F.lit(float(2 ** bucket_depth)).alias("value")))
        out.append(df.agg(*aggs).select(F.explode(F.array(*cells)).alias("p"))
                   .select("p.column", F.lit("numeric").alias("role"), "p.stat", "p.value"))
    result = out[0]
    for extra in out[1:]:
        result = result.unionByName(extra)
    return result


def binary_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns that do not hold exactly two values (null counts as one); empty when all do."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("v")) for c in cols])
    return (df.select(F.explode(pairs).alias("p")).select("p.column", "p.v")
            .groupBy("column", "v").agg(F.count(F.lit(1)))
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
            .where(F.col("n_values") != 2))


def events_per_year(df: DataFrame, ts: Column, out: str = "year") -> DataFrame:
    return df.groupBy(F.year(ts).alias(out)).agg(F.count(F.lit(1)).alias("n"))


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Centre and scale columns by their mean and sample deviation; a constant column becomes NaN."""
    aggs = [f(quoted(c)).alias(f"{p}{i}") for i, c in enumerate(cols)
            for p, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(F.struct(*aggs).alias("moments")).scalar()
    scaled = lambda c, mean, std: F.when(std == 0, F.lit(float("nan"))).otherwise((c - mean) / std)
    return df.withColumns({c: scaled(quoted(c), row.getField(f"m{i}"), row.getField(f"s{i}")) for i, c in enumerate(cols)})


def corpus_size(seqs: DataFrame, user: str, n_rows: str, ids: str, by: str = "split") -> DataFrame:
    """Users, sequences, rows and tokens per split.

    A user lies in one split, so users are counted from (split, user) groups in one shuffle.
    """
    per_user = seqs.groupBy(by, quoted(user)).agg(
        F.count(F.lit(1)).alias("s"), F.sum(n_rows).alias("r"), F.sum(F.size(ids)).alias("t"))
    return per_user.groupBy(by).agg(
        F.count(F.lit(1)).alias("users"), F.sum("s").alias("sequences"),
        F.sum("r").alias("events"), F.sum("t").alias("tokens"))
