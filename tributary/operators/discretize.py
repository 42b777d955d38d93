"""Numeric columns to codes: recursive-median bit strings, equal-width and quantile bins.

Bins and trees of a fixed, small depth are fitted into a table of at most a few thousand rows and applied as a column expression, so
applying them never shuffles. Trees of any other depth grow with the data: they stay tables, split level by level, then subtree by subtree,
and applied by a scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import quoted
from tributary.functions.local import hinted, local_table
from tributary.operators import cumulative
from tributary.operators.cumulative import RankedColumns, carried_forward
from tributary.sources.shared import Written

NULL_CODE = "nan"
#: Depth up to which a tree is a column expression: at most 4,095 nodes.
SMALL_DEPTH = 12
THRESHOLD_SCHEMA = "column string, path string, threshold double, is_leaf boolean"
EDGE_SCHEMA = "column string, edge_ix int, edge double"
NODE_SCHEMA = "column int, path string, threshold double, is_leaf boolean, above double, until double"


def median_codes(df: DataFrame, cols: list[str], depth: int = -1, range_rows: int | None = None) -> MedianCodes | MedianTree:
    """Codes of ``cols`` from their recursive medians; ``depth=-1`` splits until nothing can be split any more."""
    return (MedianCodes if 0 <= depth <= SMALL_DEPTH else MedianTree).fit(df, cols, depth, range_rows)


def stored_codes(table: DataFrame) -> MedianCodes | MedianTree:
    """The codes whose ``table`` was stored."""
    return (MedianTree if "above" in table.columns else MedianCodes).from_table(table)


class MedianCodes:
    """Bit-string codes of depth ``depth``: 0 up to the median of a node, 1 above it."""

    def __init__(self, nodes: dict[str, dict[str, float | None]]):
        # column -> path -> median, None for a leaf
        self.nodes = nodes

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], depth: int = 5, range_rows: int | None = None) -> "MedianCodes":
        """Exact medians of every node, all columns together, one small job per level.

        A node is a run of ranks of the sorted column, so its median is one or two order
        statistics. The driver holds all nodes, hence the limit on ``depth``; see ``median_codes``.
        """
        if not 0 <= depth <= SMALL_DEPTH:
            raise ValueError(f"a tree of depth {depth} is a MedianTree")
        nodes: dict[str, dict[str, float | None]] = {c: {} for c in cols}
        with RankedColumns(df, cols, range_rows) as ranked:
            level = []
            for c in cols:
                if ranked.n[c]:
                    level.append((c, "", 0, ranked.n[c]))
                else:
                    nodes[c][""] = None
            left = depth
            while level:
                if left == 0:
                    for c, path, _, _ in level:
                        nodes[c][path] = None
                    break
                ranks: dict[str, set[int]] = {}
                for c, _, lo, hi in level:
                    mid = hi - lo - 1
                    ranks.setdefault(c, set()).update((lo + mid // 2, lo + (mid + 1) // 2, hi - 1))
                found = ranked.at(ranks)
                below = []
                for c, path, lo, hi in level:
                    mid = hi - lo - 1
                    a, b = found[c][lo + mid // 2], found[c][lo + (mid + 1) // 2]
                    median = a.value if a.value == b.value else (a.value + b.value) / 2
                    if median == found[c][hi - 1].value:
                        nodes[c][path] = None
                        continue
                    nodes[c][path] = median
                    cut = b.upto if median >= b.value else a.upto
                    below.append((c, path + "0", lo, cut))
                    below.append((c, path + "1", cut, hi))
                level = below
                left -= 1
        return cls(nodes)

    def splits(self, col: str) -> bool:
        """False when the root is a leaf; such a column keeps its raw values."""
        return self.nodes[col].get("") is not None

    def code(self, col: str) -> Column:
        """The code of a column's value; null prints as ``nan``."""
        x = quoted(col).cast("double")

        def node(path: str) -> Column:
            median = self.nodes[col].get(path)
            if median is None:
                return F.lit(path)
            return F.when(x <= F.lit(median), node(path + "0")).otherwise(node(path + "1"))

        return F.when(x.isNull() | F.isnan(x), F.lit(NULL_CODE)).otherwise(node(""))

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace every fitted column that splits by its code."""
        return df.withColumns({c: self.code(c) for c in self.nodes if self.splits(c)})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, path, m, m is None) for c, tree in self.nodes.items() for path, m in tree.items()]
        return local_table(spark, rows, THRESHOLD_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> "MedianCodes":
        """Rebuild from a stored threshold table (its size is set by the depth, not the data)."""
        nodes: dict[str, dict[str, float | None]] = {}
        for r in table.collect():
            nodes.setdefault(r["column"], {})[r["path"]] = r["threshold"]
        return cls(nodes)


class MedianTree:
    """Bit-string codes of any depth. ``nodes`` (column, path, threshold, is_leaf, above, until) is a table: a node takes the values over
    ``above`` up to ``until``, null where it has no bound on that side."""

    def __init__(self, nodes: DataFrame, cols: list[str], range_rows: int | None = None):
        self.nodes, self.cols, self.range_rows = nodes, list(cols), range_rows
        self.roots = {r["column"] for r in nodes.where("path = '' AND NOT is_leaf").select("column").collect()}

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], depth: int = -1, range_rows: int | None = None) -> "MedianTree":
        """Level by level, all columns and nodes at once; nothing of a level is gathered.

        Every distinct value knows the rank interval (lo, hi) of its node. One aggregate per level finds the values at the
        middle ranks of each node; a join brings the cut back to its values. Values of finished nodes leave, and so do those of a node
        that holds at most ``range_rows`` of them: one task finishes its subtree. So the number of levels, which are written to the
        shared folder, follows the logarithm of distinct values over ``range_rows``.
        """
        cols, size = list(cols), range_rows or cumulative.RANGE_ROWS
        with RankedColumns(df, cols, range_rows) as ranked:
            count = F.lit(0)
            for i, c in enumerate(cols):
                count = F.when(F.col("column") == i, F.lit(ranked.n[c])).otherwise(count)
            bound = F.lit(None).cast("double")
            open_ = Written(ranked.table.select("column", "value", "below", "upto", F.lit(0).cast("bigint").alias("lo"), count.cast("bigint").alias("hi"),
                                                F.lit("").alias("path"), bound.alias("above"), bound.alias("until")))
            levels, left = [], depth
            while True:
                level = Written(cls._level(open_.table, left == 0))
                large, small = level.table.where(F.col("is_leaf") | (F.col("held") > size)), level.table.where(~F.col("is_leaf") & (F.col("held") <= size))
                levels.append(Written(large.select("column", "path", "threshold", "is_leaf", "above", "until").unionByName(
                    cls._subtrees(open_.table, small, left))))
                inner = large.where("NOT is_leaf")
                last = inner.isEmpty()
                deeper = None if last else Written(cls._descend(open_.table, inner))
                open_.remove()
                level.remove()
                if last:
                    break
                open_, left = deeper, left - 1
        nodes = levels[0].table
        for one in levels[1:]:
            nodes = nodes.unionByName(one.table)
        names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("column") + 1)
        empty = [(c, "", None, True, None, None) for c in cols if not ranked.n[c]]
        nodes = nodes.select(names.alias("column"), "path", "threshold", "is_leaf", "above", "until")
        if empty:
            nodes = nodes.unionByName(local_table(df.sparkSession, empty, THRESHOLD_SCHEMA + ", above double, until double"))
        whole = Written(nodes).table
        for one in levels:
            one.remove()
        return cls(whole, cols, range_rows)

    @staticmethod
    def _level(values: DataFrame, last: bool) -> DataFrame:
        """The nodes of a level with their median and the rank at which they are cut."""
        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("below") <= rank) & (rank < F.col("upto")), F.struct("value", "upto")))
        middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo") - 1) / 2), F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)
        nodes = values.groupBy("column", "lo", "hi", "path", "above", "until").agg(
            at(middle[0]).alias("a"), at(middle[1]).alias("b"), F.max("value").alias("top"), F.count(F.lit(1)).alias("held"))
        a, b = F.col("a.value"), F.col("b.value")
        nodes = nodes.withColumn("median", F.when(a == b, a).otherwise((a + b) / 2))
        leaf = F.lit(last) | (F.col("median") == F.col("top"))
        return nodes.select("column", "lo", "path", "above", "until", F.when(~leaf, F.col("median")).alias("threshold"), leaf.alias("is_leaf"),
                            F.when(F.col("median") >= b, F.col("b.upto")).otherwise(F.col("a.upto")).alias("cut"), "held")

    @staticmethod
    def _subtrees(values: DataFrame, small: DataFrame, left: int) -> DataFrame:
        """All nodes from the given ones down, a task for the values of each."""
        own = values.join(hinted(small.select("column", "lo")), ["column", "lo"], "left_semi")
        return own.groupBy("column", "lo").applyInPandas(_subtree(left), NODE_SCHEMA)

    @staticmethod
    def _descend(values: DataFrame, inner: DataFrame) -> DataFrame:
        """The values of split nodes, in their half."""
        cuts = hinted(inner.select("column", "lo", "threshold", "cut"))
        low = F.col("value") <= F.col("threshold")
        return values.join(cuts, ["column", "lo"]).select(
            "column", "value", "below", "upto", F.when(low, F.col("lo")).otherwise(F.col("cut")).alias("lo"),
            F.when(low, F.col("cut")).otherwise(F.col("hi")).alias("hi"), F.concat("path", F.when(low, "0").otherwise("1")).alias("path"),
            F.when(low, F.col("above")).otherwise(F.col("threshold")).alias("above"),
            F.when(low, F.col("threshold")).otherwise(F.col("until")).alias("until"))

    def splits(self, col: str) -> bool:
        """False when the root is a leaf; such a column keeps its raw values."""
        return col in self.roots

    def codes(self, df: DataFrame) -> DataFrame:
        """column, value, path of every distinct value of the split columns of ``df``, seen in the fit or not.

        Leaves tile the axis of each column: sorted together with the values, the last leaf that begins below a value is its own.
        """
        cols = [c for c in self.cols if self.splits(c)]
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in cols])
        values = df.select(F.explode(pairs).alias("p")).select("p.column", (F.col("p.value") + F.lit(0.0)).alias("value"))
        values = values.where(F.col("value").isNotNull() & ~F.isnan("value")).distinct()
        both = values.select("column", "value", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("path")).unionByName(
            self.nodes.where("is_leaf").select("column", F.col("above").alias("value"), F.lit(1).alias("kind"), "path"))
        placed = carried_forward(Written(both).table, ["column", "value", "kind"], "path", "code", self.range_rows)
        return Written(placed.where("kind = 0").select("column", "value", F.col("code").alias("path"))).table

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace every fitted column that splits by its code. One join per column, by value; frequent values are left to adaptive
        execution, which splits their rows."""
        cols = [c for c in self.cols if self.splits(c)]
        if not cols:
            return df
        codes, out = self.codes(df), df
        for i, c in enumerate(cols):
            side = hinted(codes.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("path").alias(f"__p{i}")))
            out = out.join(side, (quoted(c).cast("double") + F.lit(0.0)) == F.col(f"__v{i}"), "left")
        code = {c: F.coalesce(F.col(f"__p{i}"), F.lit(NULL_CODE)).alias(c) for i, c in enumerate(cols)}
        return out.select(*[code.get(c, quoted(c)) for c in df.columns])

    def table(self, spark: SparkSession) -> DataFrame:
        return self.nodes

    @classmethod
    def from_table(cls, table: DataFrame) -> "MedianTree":
        return cls(table, [r["column"] for r in table.where("path = ''").select("column").orderBy("column").collect()])


def _subtree(left: int):
    """The nodes of the tree below one node, out of its values with their ranks; all nodes of a level at once.

    The function travels whole, so executors need not have this package.
    """
    def nodes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("below")
        value, below, upto = (rows[c].to_numpy() for c in ("value", "below", "upto"))
        # A node is a run of values, from its start up to its end.
        start, end = np.array([0]), np.array([len(rows)])
        path, above, until = (np.array([rows[c].iloc[0]], dtype=t) for c, t in (("path", object), ("above", float), ("until", float)))
        levels, depth = [], left
        while len(start):
            lo, hi, top = below[start], upto[end - 1], value[end - 1]
            at_a, at_b = (np.searchsorted(upto, lo + n // 2, "right") for n in (hi - lo - 1, hi - lo))
            a, b = value[at_a], value[at_b]
            with np.errstate(over="ignore", invalid="ignore"):
                median = np.where(a == b, a, (a + b) / 2)
            # Minus and plus infinity have no middle.
            leaf = (median == top) | np.isnan(median) | (depth == 0)
            levels.append(pd.DataFrame({"path": path, "threshold": np.where(leaf, np.nan, median), "is_leaf": leaf, "above": above, "until": until}))
            start, end, path, above, until, median = (x[~leaf] for x in (start, end, path, above, until, median))
            cut = np.where(median >= b[~leaf], at_b[~leaf], at_a[~leaf]) + 1
            start, end = np.concatenate([start, cut]), np.concatenate([cut, end])
            path = np.concatenate([path + "0", path + "1"])
            above, until = np.concatenate([above, median]), np.concatenate([median, until])
            depth -= 1
        out = pd.concat(levels, ignore_index=True)
        bounds = ["threshold", "above", "until"]
        return out.assign(column=rows["column"].iloc[0], **{c: out[c].astype("Float64") for c in bounds})[
            ["column", "path", "threshold", "is_leaf", "above", "until"]]

    return nodes


def _edge_search(x: Column, edges: list[float], first: int = 0) -> Column:
    """Index of the last edge below x, as a balanced tree of comparisons; x is above edges[0]."""
    if len(edges) == 1:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(x > F.lit(edges[mid]), _edge_search(x, edges[mid:], first + mid)).otherwise(
        _edge_search(x, edges[:mid], first))


class BinEdges:
    """Integer bin codes from fitted edges; intervals are open below and closed above."""

    def __init__(self, edges: dict[str, list[float]], include_lowest: bool):
        self.edges = edges
        self.include_lowest = include_lowest

    @classmethod
    def uniform(cls, df: DataFrame, cols: list[str], n: int) -> "BinEdges":
        """Equal-width bins; the lowest edge moves down by 0.1 % of the range."""
        clean = {c: F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double")) for c in cols}
        row = df.agg(*[f(clean[c]).alias(f"{p}{i}") for i, c in enumerate(cols)
                       for p, f in (("lo", F.min), ("hi", F.max))]).first()
        edges = {}
        for i, c in enumerate(cols):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is None:
                edges[c] = []
                continue
            if lo == hi:
                pad = 0.001 * abs(lo) if lo else 0.001
                lo, hi = lo - pad, hi + pad
                edges[c] = [lo + k * ((hi - lo) / n) for k in range(n)] + [hi]
                continue
            step = (hi - lo) / n
            edges[c] = [lo + k * step for k in range(n)] + [hi]
            edges[c][0] = lo - (hi - lo) * 0.001
        return cls(edges, include_lowest=False)

    @classmethod
    def quantile(cls, df: DataFrame, cols: list[str], n: int, range_rows: int | None = None) -> "BinEdges":
        """Equal-count bins from exact interpolated quantiles; equal edges are merged."""
        with RankedColumns(df, cols, range_rows) as ranked:
            spots = {}
            for c in cols:
                top = ranked.n[c] - 1
                spots[c] = [] if top < 0 else [(top * k // n, top * k % n / n) for k in range(n + 1)]
            found = ranked.at({c: {r for lo, f in s for r in ((lo, lo + 1) if f else (lo,))}
                               for c, s in spots.items()})
        edges = {}
        for c, s in spots.items():
            values = []
            for lo, f in s:
                a = found[c][lo].value
                b = found[c][lo + 1].value if f else a
                values.append(a if a == b else a + (b - a) * f)
            edges[c] = sorted(set(values))
        return cls(edges, include_lowest=True)

    def code(self, col: str) -> Column:
        """Code on the fitted data; null outside the edges."""
        edges = self.edges[col]
        x = quoted(col).cast("double")
        if len(edges) < 2:
            return F.lit(None).cast("int")
        inside = (x > F.lit(edges[0])) & (x <= F.lit(edges[-1]))
        out = F.when(inside, _edge_search(x, edges[:-1]))
        if self.include_lowest:
            out = F.when(x == F.lit(edges[0]), F.lit(0)).otherwise(out)
        return out.cast("int")

    def applied(self, col: str, parent: str | None = None) -> Column:
        """Code of new data: null and out-of-range values become 0.

        A derived column (the mean of an amount, say) uses the edges of its ``parent``.
        """
        edges = self.edges[parent or col]
        x = quoted(col).cast("double")
        if len(edges) < 2:
            return F.lit(0)
        inside = (x > F.lit(edges[0])) & (x <= F.lit(edges[-1]))
        return F.coalesce(F.when(inside, _edge_search(x, edges[:-1])), F.lit(0)).cast("int")

    def transform(self, df: DataFrame, fitted: bool = True) -> DataFrame:
        return df.withColumns({c: self.code(c) if fitted else self.applied(c) for c in self.edges})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, i, float(e)) for c, es in self.edges.items() for i, e in enumerate(es)]
        return local_table(spark, rows, EDGE_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame, include_lowest: bool) -> "BinEdges":
        edges: dict[str, list[tuple[int, float]]] = {}
        for r in table.collect():
            edges.setdefault(r["column"], []).append((r["edge_ix"], r["edge"]))
        return cls({c: [e for _, e in sorted(es)] for c, es in edges.items()}, include_lowest)
