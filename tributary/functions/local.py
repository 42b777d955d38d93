"""Small driver-side tables (fitted edges, class lists) as local relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A table of a few rows. Arrow input becomes a local relation: no job and no Python worker
    is needed to read it, unlike a table made from a list of rows."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


#: Most rows of a table that is broadcast by hint.
BROADCAST_ROWS = 500_000


def hinted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; a larger one is joined as Spark sees fit, with the same result."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
