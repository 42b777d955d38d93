"""Role schemas and readers of the event tables that can be prepared end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import columns as C
from tributary.functions.columns import quoted
from tributary.operators.layout import EntityLayout
from tributary.operators.normalize import normalise_with_layout, select_raw
from tributary.schema import EventSchema


@dataclass(frozen=True)
class Dataset:
    """How one kind of event table becomes normalised events.

    ``prepare`` renames and parses raw columns; ``timestamp`` gives the event time from the
    prepared table. ``read_schema`` is the explicit type list of the raw files.
    """

    name: str
    schema: EventSchema
    read_schema: str
    timestamp: Callable[[], Column]
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    fmt: str = "csv"
    sep: str = ","
    consolidate: dict | None = None

    def normalise(self, raw: DataFrame) -> DataFrame:
        """Normalised events; columns the tie needs are kept beside the configured raw ones."""
        return self.normalise_with_layout(raw)[0]

    def normalise_with_layout(self, raw: DataFrame) -> tuple[DataFrame, EntityLayout]:
        """Normalised events and the layout that was fitted for their gaps."""
        return normalise_with_layout(self.prepare(select_raw(raw, self.schema)), self.schema, self.timestamp())


def _cards(df: DataFrame) -> DataFrame:
    return df.withColumns({"Amount": C.money(F.col("Amount")),
                           "is_online": C.equals_flag(quoted("Merchant City"))})


CARDS = Dataset(
    name="card_transactions",
    schema=EventSchema(
        index=["User", "Card"], tie=["line_no"],
        categorical=["Use Chip", "Merchant State", "Errors?", "MCC", "Merchant Name", "Merchant City", "Zip"],
        numeric=["Amount", "Hour", "total_minutes_from_last", "Year", "Month", "Day"],
        binary=["Is Fraud?"], label=["Is Fraud?"]),
    read_schema=("User int, Card int, Year int, Month int, Day int, Time string, Amount string, `Use Chip` string, "
                 "`Merchant Name` bigint, `Merchant City` string, `Merchant State` string, Zip double, MCC int, "
                 "`Errors?` string, `Is Fraud?` string"),
    prepare=_cards,
    timestamp=lambda: C.clock_timestamp(F.col("Year"), F.col("Month"), F.col("Day"), F.col("Time")))

REVIEWS = Dataset(
    name="product_reviews",
    schema=EventSchema(
        index=["User"], tie=["line_no"], categorical=["asin"], numeric=["total_minutes_from_last"],
        binary=["verified"], label=["overall"],
        raw=["asin", "overall", "unixReviewTime", "verified", "reviewerID", "line_no"]),
    read_schema="asin string, overall double, unixReviewTime bigint, verified boolean, reviewerID string",
    prepare=lambda df: df.withColumn("User", F.col("reviewerID")),
    timestamp=lambda: C.epoch_timestamp(F.col("unixReviewTime")), fmt="json",
    consolidate={"overall": {"1.0": 0, "2.0": 0, "3.0": 0, "4.0": 1, "5.0": 1}})

CHURN = Dataset(
    name="bank_churn",
    schema=EventSchema(
        index=["User"], tie=["line_no"], categorical=["trx_category", "MCC", "channel_type", "currency"],
        numeric=["amount", "total_minutes_from_last"], label=["target_flag"],
        raw=["cl_id", "MCC", "channel_type", "currency", "TRDATETIME", "amount", "trx_category", "target_flag", "line_no"]),
    read_schema=("PERIOD string, cl_id bigint, MCC int, channel_type string, currency int, TRDATETIME string, "
                 "amount double, trx_category string, target_flag int, target_sum double"),
    prepare=lambda df: df.withColumnRenamed("cl_id", "User"),
    timestamp=lambda: C.compact_timestamp(F.col("TRDATETIME")), sep=";")

LOANS = Dataset(
    name="loans",
    schema=EventSchema(
        index=["User"], tie=["trans_id"], categorical=["type", "operation", "k_symbol", "bank"],
        numeric=["amount", "balance", "total_minutes_from_last"], label=["labels"],
        raw=["trans_id", "account_id", "type", "operation", "amount", "balance", "k_symbol", "bank", "event_time",
             "labels", "loan_time"]),
    read_schema=("trans_id bigint, account_id bigint, type string, operation string, amount double, balance double, "
                 "k_symbol string, bank string, event_time bigint, labels int, loan_time bigint"),
    prepare=lambda df: df.withColumnRenamed("account_id", "User"),
    timestamp=lambda: C.epoch_timestamp(F.col("event_time")), sep=";")

AIR_QUALITY = Dataset(
    name="air_quality",
    schema=EventSchema(
        index=["station"], tie=["No"], categorical=["wd"],
        numeric=["hour", "total_minutes_from_last", "year", "month", "day", "PM2.5", "PM10", "SO2", "NO2", "CO", "O3",
                 "TEMP", "PRES", "DEWP", "RAIN", "WSPM"],
        label=["PM2.5", "PM10"]),
    read_schema=("No bigint, year int, month int, day int, hour int, `PM2.5` double, PM10 double, SO2 double, NO2 double, "
                 "CO double, O3 double, TEMP double, PRES double, DEWP double, RAIN double, wd string, WSPM double, "
                 "station string"),
    timestamp=lambda: C.clock_timestamp(F.col("year"), F.col("month"), F.col("day"), hour=F.col("hour")))


def _activity(df: DataFrame) -> DataFrame:
    return df.withColumns({"k": F.get_json_object("props", "$.k"), "is_error": F.col("event_type") == "error"})


ACTIVITY = Dataset(
    name="user_activity",
    schema=EventSchema(
        index=["user_id"], tie=["ts", "event_id"], categorical=["k"],
        numeric=["value", "Hour", "total_minutes_from_last"], binary=["is_error"], label=["event_type"],
        raw=["event_id", "ts", "user_id", "event_type", "value", "props"]),
    read_schema="event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    prepare=_activity, timestamp=lambda: F.col("ts"), fmt="parquet",
    consolidate={"event_type": {"click": 0, "view": 0, "purchase": 1, "signup": 1, "error": 1}})

DATASETS = {d.name: d for d in (CARDS, REVIEWS, CHURN, LOANS, AIR_QUALITY, ACTIVITY)}


def with_line_number(raw: DataFrame, out: str = "line_no") -> DataFrame:
    """Tie key for sources that have none: a digest of the whole row.

    It depends on the row's content only, unlike a running number, so every reader and every
    retry orders equal-time rows the same way. Rows equal in all columns are interchangeable.
    """
    return raw.withColumn(out, F.md5(F.to_json(F.struct(*map(quoted, raw.columns)))))
