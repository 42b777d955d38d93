"""Compare a Spark result with the SQL result of the same query."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].where(df[c].notna(), None)
    keys = df.apply(lambda r: tuple("" if pd.isna(v) else repr(v) for v in r), axis=1) if len(df) else []
    return df.assign(__k=keys).sort_values("__k").drop(columns="__k").reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """A description of the first difference, None when the results are equal."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = _canonical(spark_df), _canonical(sql_df)
    for c in a.columns:
        if str(a[c].dtype) != str(b[c].dtype):
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int((~same).idxmax())
            return f"{int((~same).sum())} rows differ in {c}, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None
