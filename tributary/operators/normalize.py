"""Typing, time columns and gaps: a raw event table to normalised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import columns as C
from tributary.functions.columns import quoted
from tributary.operators.layout import EntityLayout, with_gap
from tributary.schema import EventSchema


def select_raw(df: DataFrame, schema: EventSchema) -> DataFrame:
    """Keep the configured raw columns; an empty list keeps all."""
    return df.select(*map(quoted, schema.raw)) if schema.raw else df


def select_data(df: DataFrame, schema: EventSchema, extra: list[str] = ()) -> DataFrame:
    """Data columns in contract order, then index columns, then order columns."""
    names = dict.fromkeys([*schema.data_cols, *schema.index, *extra])
    return df.select(*map(quoted, names))


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to top-level columns named by their path."""

    def leaves(path: list[str], dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from leaves(path + [f.name], f.dataType)
        else:
            yield path

    cols = []
    for f in df.schema.fields:
        for path in leaves([f.name], f.dataType):
            c = quoted(path[0])
            for name in path[1:]:
                c = c.getField(name)
            cols.append(c.alias(sep.join(path)))
    return df.select(*cols)


def convert_types(df: DataFrame, schema: EventSchema) -> DataFrame:
    """Numeric columns to double, categories and binaries to text; other columns stay.

    A float category prints as integers only when the whole column is whole, which takes one
    aggregate over those columns; tables without float categories are only projected.
    """
    floats = [c for c in schema.categorical if c not in schema.numeric and c in df.columns
              and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    whole: dict[str, Column] = {}
    if floats:
        flags = []
        for i, c in enumerate(floats):
            d = quoted(c).cast("double")
            flags.append(F.coalesce(F.bool_and(F.when(~F.isnan(d), C.is_whole(d))), F.lit(True)).alias(f"w{i}"))
        row = df.agg(F.struct(*flags).alias("flags")).scalar()
        whole = {c: row.getField(f"w{i}") for i, c in enumerate(floats)}
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if f.name in schema.numeric:
            c = C.to_number(c)
        elif f.name in schema.categorical:
            c = C.category_text(c, f.dataType, whole.get(f.name))
        elif f.name in schema.binary:
            c = C.binary_text(c, f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def rejected_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many non-null values of each column cannot be read as numbers."""
    aggs = [F.count(F.when(quoted(c).isNotNull() & C.to_number(quoted(c)).isNull(), 1)).alias(f"r{i}")
            for i, c in enumerate(cols)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("rejected"))
                      for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.explode(cells).alias("p")).select("p.column", "p.rejected")


def add_time(df: DataFrame, ts: Column, minutes: str = "total_minutes", hour: str = "Hour") -> DataFrame:
    """Hour of day and whole minutes since 1970; an hour column the table brings along stays."""
    new = {minutes: C.epoch_minutes(ts)}
    if hour.lower() not in [c.lower() for c in df.columns]:
        new[hour] = F.hour(ts)
    return df.withColumns(new)


def clean_categories(df: DataFrame, schema: EventSchema) -> DataFrame:
    return df.withColumns({c: C.without_spaces(quoted(c)) for c in schema.categorical})


def normalise_with_layout(df: DataFrame, schema: EventSchema, ts: Column, layout: EntityLayout | None = None) -> tuple[DataFrame, EntityLayout]:
    """Type the columns, add time columns and the gap, clean categories, keep the role columns; and the layout of the events.

    ``ts`` may use any input column. The order columns stay in the result: rows of a DataFrame
    have no order of their own, so later steps need them.
    """
    timed = add_time(df.withColumn("__ts", ts), F.col("__ts"), schema.minutes).drop("__ts")
    typed = convert_types(timed, schema)
    layout = layout or EntityLayout.fit(typed, schema.index, schema.gap_order)
    out = typed
    if "total_minutes_from_last" in schema.numeric:
        out = with_gap(typed, layout, schema.minutes)
        out = out.withColumn("total_minutes_from_last", F.col("total_minutes_from_last").cast("double"))
    return select_data(clean_categories(out, schema), schema, schema.order), layout


def normalise(df: DataFrame, schema: EventSchema, ts: Column, layout: EntityLayout | None = None) -> DataFrame:
    """The normalised events alone."""
    return normalise_with_layout(df, schema, ts, layout)[0]
