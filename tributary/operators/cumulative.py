"""Exact order statistics and scans in order (running totals, values carried forward) without sorting a table in one task.

A scan has two levels. Rows are cut into ranges of some RANGE_ROWS rows, as many as the row count asks for; a window runs inside each
range, and what the ranges before it add up to comes from one summary row per range, scanned the same way. The cuts decide
how even the ranges are, never the result.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.functions.columns import quoted
from tributary.functions.local import hinted
from tributary.sources.shared import Written

#: Rows that one window task sorts.
RANGE_ROWS = 500_000


def bin_of(value: Column, edges: Column, bins: int) -> Column:
    """Number of edges below the value, by binary search in a sorted array of ``bins - 1``.

    Written as a fold over the step widths: a chain of columns would be inlined into itself
    whenever a filter is pushed below it.
    """
    steps = F.expr("array(" + ", ".join(str(1 << k) for k in reversed(range(bins.bit_length() - 1))) + ")")
    below = lambda b, s: F.when(value > F.element_at(edges, b + s), b + s).otherwise(b)
    return F.coalesce(F.aggregate(steps, F.lit(0), below), F.lit(0))


def _scan(df: DataFrame, order: list[str], value: str, out: str, range_rows: int | None, last: bool) -> DataFrame:
    """Adds ``out``: the sum (``last``: the last non-null) of ``value`` over the rows up to each one in ascending ``order``."""
    size = range_rows or RANGE_ROWS
    kinds = [quoted(c) for c in order]
    upto = lambda v, w: F.last(v, True).over(w) if last else F.sum(v).over(w)
    ranges = -(-df.count() // size)
    if ranges <= 1:  # at most ``size`` rows: the only window without a partition key
        return df.withColumn(out, upto(quoted(value), W.orderBy(*kinds).rowsBetween(W.unboundedPreceding, 0)))
    # Written, a range keeps its rows, whatever happens to the executors.
    cut = Written(df.repartitionByRange(ranges, *kinds).withColumn("__range", F.spark_partition_id())).table
    newest = F.max_by(quoted(value), F.when(quoted(value).isNotNull(), F.struct(*kinds)))
    sums = cut.groupBy(F.col("__range").alias("__at")).agg((newest if last else F.sum(quoted(value))).alias("__sum"))
    before = _scan(sums, ["__at"], "__sum", "__upto", size, last)
    # The summary of a range counts from the next one on.
    before = _shifted(before, size) if last else before.select("__at", (F.col("__upto") - F.coalesce("__sum", F.lit(0))).alias("__before"))
    within = upto(quoted(value), W.partitionBy("__range").orderBy(*kinds).rowsBetween(W.unboundedPreceding, 0))
    whole = F.coalesce("__within", "__before") if last else F.coalesce(F.col("__within") + F.coalesce("__before", F.lit(0)), "__before")
    return (cut.withColumn("__within", within).join(hinted(before.withColumnRenamed("__at", "__range")), "__range", "left")
            .select(*[quoted(c) for c in df.columns], whole.alias(out)))


def _shifted(sums: DataFrame, size: int) -> DataFrame:
    """What is carried into each range: the value up to the end of the one before. Ranges without rows have no summary."""
    numbered = _scan(sums.withColumn("__one", F.lit(1).cast("bigint")), ["__at"], "__one", "__n", size, False)
    earlier = numbered.select((F.col("__n") + 1).alias("__n"), F.col("__upto").alias("__before"))
    return numbered.select("__at", "__n").join(earlier, "__n", "left").select("__at", "__before")


def running_total(df: DataFrame, order: list[str], amount: str, out: str, range_rows: int | None = None) -> DataFrame:
    """Inclusive running sum of ``amount`` over rows in ascending ``order`` (unique)."""
    return _scan(df, order, amount, out, range_rows, False)


def carried_forward(df: DataFrame, order: list[str], value: str, out: str, range_rows: int | None = None) -> DataFrame:
    """The last non-null ``value`` up to each row in ascending ``order`` (unique), null before the first."""
    return _scan(df, order, value, out, range_rows, True)


@dataclass(frozen=True)
class Found:
    """A value of a sorted column: rows below it and rows up to and including it."""

    value: float
    below: int
    upto: int


class RankedColumns:
    """Values at given ranks of several numeric columns, nulls and NaN left out.

    One shuffle counts distinct values of all columns together, a scan over ranges gives every value its rank interval: ``table`` has
    column (number), value, below and upto. It lies in the shared folder until ``close``. Each call of ``at`` only scans it;
    the driver keeps the values it asked for.
    """

    def __init__(self, df: DataFrame, cols: list[str], range_rows: int | None = None):
        self.cols = list(cols)
        self.spark = df.sparkSession
        pairs = F.array(*[F.struct(F.lit(i).alias("column"), quoted(c).cast("double").alias("value"))
                          for i, c in enumerate(self.cols)])
        long = (df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
                .where(F.col("value").isNotNull() & ~F.isnan("value")))
        # -0.0 and 0.0 are one value.
        hist = Written(long.groupBy("column", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n")))
        rows = {r["column"]: int(r["n"]) for r in hist.table.groupBy("column").agg(F.sum("n").alias("n")).collect()}
        self.n = {c: rows.get(i, 0) for i, c in enumerate(self.cols)}
        # One scan over all columns, one after the other; ranks of a column start behind the rows of those before it.
        start, before = 0, F.lit(0).cast("bigint")
        for i, c in enumerate(self.cols):
            before, start = F.when(F.col("column") == i, F.lit(start)).otherwise(before), start + self.n[c]
        total = running_total(hist.table, ["column", "value"], "n", "upto", range_rows)
        ranked = total.select("column", "value", "n", (F.col("upto") - before).alias("upto"))
        self._written = Written(ranked.select("column", "value", (F.col("upto") - F.col("n")).alias("below"), "upto"))
        self.table = self._written.table
        hist.remove()

    def at(self, ranks: dict[str, set[int]]) -> dict[str, dict[int, Found]]:
        """The value at each 0-based rank of each column; one scan without a shuffle."""
        out: dict[str, dict[int, Found]] = {c: {} for c in ranks}
        asked = {self.cols.index(c): sorted(r) for c, r in ranks.items() if r}
        if not asked:
            return out
        size = 2
        while size - 1 < max(map(len, asked.values())):
            size *= 2
        wanted = F.lit(None).cast("array<bigint>")
        for i, r in asked.items():
            padded = F.expr("array(" + ", ".join(f"{x}L" for x in r + [r[-1]] * (size - 1 - len(r))) + ")")
            wanted = F.when(F.col("column") == i, padded).otherwise(wanted)
        # A value holds an asked rank when the number of asked ranks below its end exceeds the
        # number below its start.
        hit = bin_of(F.col("upto"), F.col("wanted"), size) > bin_of(F.col("below"), F.col("wanted"), size)
        found = (self.table.where(F.col("column").isin(list(asked))).withColumn("wanted", wanted)
                 .where(hit).select("column", "value", "below", "upto").collect())
        for r in found:
            spots = asked[r["column"]]
            for rank in spots[bisect.bisect_left(spots, r["below"]):bisect.bisect_left(spots, r["upto"])]:
                out[self.cols[r["column"]]][rank] = Found(r["value"], r["below"], r["upto"])
        return out

    def close(self) -> None:
        self._written.remove()

    def __enter__(self) -> "RankedColumns":
        return self

    def __exit__(self, *exc) -> None:
        self.close()
