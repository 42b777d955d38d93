"""Typing and time expressions on hand-made values."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import columns as C
from tributary.operators import normalize
from tributary.schema import EventSchema


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_category_text_of_whole_and_mixed_floats(spark):
    df = spark.createDataFrame([(5411.0, 1.5), (None, 3.0), (3.0, None)], "whole double, mixed double")
    schema = EventSchema(index=["i"], tie=["i"], categorical=["whole", "mixed"])
    rows = normalize.convert_types(df, schema).collect()
    assert [r["whole"] for r in rows] == ["5411", "NAN", "3"]
    assert [r["mixed"] for r in rows] == ["1.5", "3.0", "NAN"]


def test_boolean_text(spark):
    got = [one(spark, C.binary_text(F.lit(w), T.StringType()))[0] for w in ("Yes", "no", "TRUE", "false", "Maybe")]
    assert got == ["True", "False", "True", "False", "maybe"]
    assert one(spark, C.binary_text(F.lit(True), T.BooleanType()))[0] == "True"


def test_money(spark):
    row = one(spark, C.money(F.lit("$12.50")), C.money(F.lit("$-12.50")), C.money(F.lit("-$1")), C.money(F.lit("free")),
              C.money(F.lit("$7.389"), True), C.money(F.lit("$-1"), True))
    assert row[:4] == (12.5, -12.5, -1.0, None)
    assert math.isclose(row[4], math.log(7.389)) and row[5] is None


def test_timestamps(spark):
    row = one(spark, C.compact_timestamp(F.lit("21OCT17:00:00:00")).cast("string"),
              C.compact_timestamp(F.lit("01JAN95:10:20:30")).cast("string"), C.compact_timestamp(F.lit("soon")),
              C.clock_timestamp(F.lit(2020), F.lit(2.0), F.lit(3), F.lit("06:07")).cast("string"),
              C.epoch_minutes(C.epoch_timestamp(F.lit(1352419200))), C.epoch_minutes(C.epoch_timestamp(F.lit(-30))))
    assert row == ("2017-10-21 00:00:00", "1995-01-01 10:20:30", None, "2020-02-03 06:07:00", 1352419200 // 60, -1)


def test_time_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = one(spark, C.epoch_seconds(F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")),
                  C.epoch_timestamp(F.lit(0)).cast("string"), C.compact_timestamp(F.lit("10MAR24:02:30:00")).cast("string"))
        assert row[0] == 1719792000 and row[1] == "1970-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_joined_prints_nulls_and_mapping_defaults(spark):
    row = one(spark, C.joined([F.lit("a"), F.lit(None).cast("string"), F.lit(1)]), C.mapped(F.lit("x"), {"x": 1}),
              C.mapped(F.lit("y"), {"x": 1}), C.equals_flag(F.lit(None).cast("string")), C.last_chars(F.lit("abcdefg")))
    assert row == ("a_nan_1", 1, None, False, "cdefg")


def test_numbers_reject_text_and_nan(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(C.to_number(F.col("v"))).collect()] == [1.5, None, None, None]
    assert normalize.rejected_numbers(df, ["v"]).first()["rejected"] == 2


def test_flatten_and_strip(spark):
    df = spark.createDataFrame([((1, ("x",)), 2)], "a struct<b:int,c:struct<`d.e`:string>>, f int")
    assert normalize.flatten_struct(df).columns == ["a_b", "a_c_d.e", "f"]
    assert normalize.strip_names(spark.createDataFrame([(1,)], "` x ` int")).columns == ["x"]


def test_column_order_contract():
    s = EventSchema(index=["u", "card"], tie=["t"], categorical=["c", "y"], numeric=["n"], binary=["b"], label=["y", "z"])
    assert s.data_cols == ["c", "y", "n", "b", "z"]
    assert s.n_cols == 6 and s.label_position() == 4 and s.label_position("y") == 1
    assert s.order == ["card", "total_minutes", "t"]


def test_drawn_below_equals_the_number(spark):
    df = spark.range(500).select(C.digest(F.col("id")).alias("h"))
    for share in (0.0, 0.15, 0.5, 1.0):
        assert df.where(C.drawn_below(F.col("h"), share, 1) != (C.uniform_of(F.col("h"), 1) < share)).count() == 0
