"""Order of the events of one entity: ordinal, previous values, last event, chunks.

Window functions put all rows of a key into one task. That is right for millions of ordinary
entities and wrong for one entity that holds a large share of the table. A layout is fitted
once per table: it counts rows per entity, and entities above ``split_rows`` are cut into
cells of about ``cell_rows`` rows between sampled values of their whole order, so columns of any type cut and so do events that share
one time. Windows then run per (entity, cell) and are stitched with one summary row per cell: no task ever sees a whole hot
entity. Results are the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.functions.columns import quoted
from tributary.functions.local import BROADCAST_ROWS, local_table
from tributary.sources.shared import Written

#: An entity is cut when it holds more rows than this, however many such entities there are, into cells of about so many rows.
SPLIT_ROWS, CELL_ROWS = 5_000_000, 500_000
#: Most cells of an entity, and most cells of all entities beside one for each: the splitters are broadcast.
MAX_CELLS, ALL_CELLS = 65_536, BROADCAST_ROWS
#: Sampled rows per cell: more make the cells more even.
OVERSAMPLE = 8
#: A list of at most so many entities is held by the driver; a longer one is a table in the shared folder.
MAX_HOT = 8192

_CELL = "__cell"


def _cell_of(order: Column, edges: Column) -> Column:
    """Number of edges below the order, by binary search in an ascending array; 0 without edges."""
    steps = F.expr("array(" + ", ".join(str(1 << k) for k in reversed(range(MAX_CELLS.bit_length()))) + ")")
    # Past the end there is no edge, and a comparison with null keeps the place.
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda b, s: F.when(order > F.get(edges, b + s - 1), b + s).otherwise(b)), F.lit(0))


@dataclass
class EntityLayout:
    """``hot`` has the keys of cut entities and the array ``__edges`` of orders between their cells."""

    keys: list[str]
    order: list[str]
    hot: DataFrame | None = None

    @classmethod
    def fit(cls, df: DataFrame, keys, order, split_rows: int | None = None, cell_rows: int | None = None) -> "EntityLayout":
        """Find the entities that need cutting; most tables have none. One count per entity, whatever the size of the input.

        Rows of hot entities are sampled by a hash of entity and order, so a retry takes the same ones; only their orders are
        gathered, at most OVERSAMPLE for each cell.
        """
        keys, order = list(keys), list(order)
        split_rows = SPLIT_ROWS if split_rows is None else split_rows
        cell_rows = min(CELL_ROWS, max(1, split_rows // 10)) if cell_rows is None else cell_rows
        if not order:
            raise ValueError("an event order is needed")
        names = [f"__hot{i}" for i in range(len(keys))]
        counts = df.groupBy(*[quoted(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("__n"))
        big = counts.where(F.col("__n") > split_rows)
        rows = big.limit(MAX_HOT + 1).collect()
        if not rows:
            return cls(keys, order)
        big = local_table(df.sparkSession, [tuple(r) for r in rows], big.schema) if len(rows) <= MAX_HOT else Written(big).table
        total = big.agg(F.sum("__n")).first()[0]
        cells = F.least(F.lit(MAX_CELLS), F.ceil(F.col("__n") / max(cell_rows, -(-total // ALL_CELLS)))).cast("int")
        big = big.withColumn("__cells", cells)
        layout = cls(keys, order, big)
        place = F.pmod(F.xxhash64(*map(quoted, [*keys, *order])), F.lit(1 << 31)) / float(1 << 31)
        sample = df.join(F.broadcast(big), layout._match(names)).where(place < F.col("__cells") * OVERSAMPLE / F.col("__n"))
        edges = sample.groupBy(*names, "__cells").agg(F.sort_array(F.collect_list(layout._place())).alias("__sample"))
        every = F.size("__sample") / F.col("__cells")
        edges = edges.where("__cells > 1").select(*names, F.transform(
            F.sequence(F.lit(1), F.col("__cells") - 1), lambda i: F.get("__sample", F.floor(i * every).cast("int"))).alias("__edges"))
        return cls(keys, order, Written(edges).table)

    @property
    def is_split(self) -> bool:
        return self.hot is not None

    def _order(self) -> list[Column]:
        return [quoted(c) for c in self.order]

    def _place(self) -> Column:
        """The order of a row as one value."""
        return F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(self.order)])

    def _match(self, names: list[str]) -> Column:
        match = F.lit(True)
        for k, n in zip(self.keys, names, strict=True):
            match = match & quoted(k).eqNullSafe(F.col(n))
        return match

    def _with_cell(self, df: DataFrame, how: str) -> DataFrame:
        """Tag rows of hot entities with their cell; other rows get cell 0 or are dropped."""
        names = [f"__hot{i}" for i in range(len(self.keys))]
        # At most ALL_CELLS edges, and one for each entity.
        return (df.join(F.broadcast(self.hot), self._match(names), how)
                .withColumn(_CELL, _cell_of(self._place(), F.col("__edges")).cast("bigint")).drop(*names, "__edges"))

    def _cells(self, df: DataFrame, lags: dict[str, str]) -> DataFrame:
        """One row per (hot entity, cell): rows before it, values just before it, is it last."""
        rows = self._with_cell(df, "inner")
        order = F.struct(*self._order())
        last = F.max_by(F.struct(*[quoted(c).alias(n) for n, c in lags.items()],
                                 F.lit(1).alias("__seen")), order)
        cells = rows.groupBy(*map(quoted, self.keys), _CELL).agg(
            F.count(F.lit(1)).alias("__rows"), last.alias("__last"))
        w = W.partitionBy(*map(quoted, self.keys)).orderBy(_CELL)
        return cells.select(
            *map(quoted, self.keys), _CELL,
            F.coalesce(F.sum("__rows").over(w.rowsBetween(W.unboundedPreceding, -1)),
                       F.lit(0)).alias("__before"),
            F.lag("__last").over(w).alias("__prev"),
            F.lead(F.lit(True), 1, False).over(w).alias("__more"))

    def number(self, df: DataFrame, ordinal: str | None = "pos", lags: dict[str, str] | None = None,
               is_last: str | None = None, previous: str | None = None) -> DataFrame:
        """Add the 1-based ordinal of each event in its entity, lagged columns and a last flag.

        ``lags`` maps new column names to the column whose previous value they take.
        ``previous`` names a flag that is true when the entity has an earlier event.
        All of them share one exchange and one sort.
        """
        lags = lags or {}
        keys = [quoted(k) for k in self.keys]
        base = [quoted(c) for c in df.columns]
        if not self.is_split:
            w = W.partitionBy(*keys).orderBy(*self._order())
            new = [F.lag(quoted(c)).over(w).alias(n) for n, c in lags.items()]
            if ordinal:
                new.append(F.row_number().over(w).cast("bigint").alias(ordinal))
            if previous:
                new.append((F.row_number().over(w) > 1).alias(previous))
            if is_last:
                new.append((~F.lead(F.lit(True), 1, False).over(w)).alias(is_last))
            return df.select(*base, *new)

        rows = self._with_cell(df, "left")
        w = W.partitionBy(*keys, F.col(_CELL)).orderBy(*self._order())
        rows = rows.select(
            *base, _CELL, F.row_number().over(w).cast("bigint").alias("__rn"),
            *[F.lag(quoted(c)).over(w).alias(f"__lag{i}") for i, c in enumerate(lags.values())],
            F.lead(F.lit(True), 1, False).over(w).alias("__next"))
        names = [f"__k{i}" for i in range(len(keys))]
        cells = self._cells(df, lags)
        cells = cells.toDF(*names, "__c", *cells.columns[len(keys) + 1:])
        match = F.col(_CELL) == F.col("__c")
        for k, n in zip(keys, names):
            match = match & k.eqNullSafe(F.col(n))
        rows = rows.join(cells, match, "left")
        first = F.col("__rn") == 1
        before = F.coalesce(F.col("__before"), F.lit(0))
        new = [F.when(first, F.col("__prev").getField(n)).otherwise(F.col(f"__lag{i}")).alias(n)
               for i, n in enumerate(lags)]
        if ordinal:
            new.append((F.col("__rn") + before).alias(ordinal))
        if previous:
            new.append(((F.col("__rn") + before) > 1).alias(previous))
        if is_last:
            new.append((~F.col("__next") & ~F.coalesce(F.col("__more"), F.lit(False))).alias(is_last))
        return rows.select(*base, *new)


def with_gap(df: DataFrame, layout: EntityLayout, minutes: str = "total_minutes",
             out: str = "total_minutes_from_last") -> DataFrame:
    """Minutes since the previous event of the entity, 0 for its first event."""
    gap = quoted(minutes) - F.col("__previous_minutes")
    return (layout.number(df, ordinal=None, lags={"__previous_minutes": minutes})
            .withColumn(out, F.coalesce(gap, F.lit(0)).cast("bigint")).drop("__previous_minutes"))


def with_ordinal(df: DataFrame, layout: EntityLayout, out: str = "pos") -> DataFrame:
    return layout.number(df, ordinal=out)


def with_last_flag(df: DataFrame, layout: EntityLayout, out: str = "is_last") -> DataFrame:
    return layout.number(df, ordinal=None, is_last=out)


def mask_last_event(df: DataFrame, layout: EntityLayout, cols: list[str], mark: str = "?") -> DataFrame:
    """Show the last event of each entity with the chosen cells hidden, all cells as text."""
    flagged = with_last_flag(df, layout, "__is_last")
    return flagged.select(*[
        F.when(F.col("__is_last"), F.lit(mark)).otherwise(quoted(c).cast("string")).alias(c)
        if c in cols else quoted(c) for c in df.columns])


def change_points(df: DataFrame, layout: EntityLayout, cols: list[str], out: str = "changed") -> DataFrame:
    """Names of the columns whose value differs from the previous row of the same group.

    The first row of a group lists every column. ``layout.keys`` bounds how far apart two rows
    may be and still be compared; a table-wide comparison would need one task.
    """
    lagged = layout.number(df, ordinal=None, previous="__has_previous",
                           lags={f"__was{i}": c for i, c in enumerate(cols)})
    marks = [F.when(~F.col("__has_previous") | ~quoted(c).eqNullSafe(F.col(f"__was{i}")), F.lit(c))
             for i, c in enumerate(cols)]
    return lagged.select(*[quoted(c) for c in df.columns], F.array_compact(F.array(*marks)).alias(out))


def run_ranges(df: DataFrame, layout: EntityLayout) -> DataFrame:
    """First and one-past-last position of each entity when entities are laid out in key order.

    Positions are cumulative entity sizes. Only sizes travel; events are counted map-side.
    """
    from tributary.operators.cumulative import running_total

    sizes = df.groupBy(*map(quoted, layout.keys)).agg(F.count(F.lit(1)).alias("n"))
    ends = running_total(sizes, layout.keys, "n", "end")
    return ends.select(*map(quoted, layout.keys), (F.col("end") - F.col("n")).alias("start"), "end", "n")
