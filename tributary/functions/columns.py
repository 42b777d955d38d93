"""Typing, cleaning and time expressions. Every function maps columns to a column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "NAN"
# The words read as booleans and their text form.
BOOLEAN_WORDS = {"yes": "True", "no": "False", "true": "True", "false": "False"}

_FLOATS = (T.DoubleType, T.FloatType)


def quoted(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_number(c: Column) -> Column:
    """Double, with NaN and unreadable text as null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def boolean_text(c: Column) -> Column:
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def category_text(c: Column, dtype: T.DataType, all_whole: Column | None = None) -> Column:
    """Text of a category: whole floats print as integers, null prints as ``NAN``.

    ``all_whole`` tells whether every value of the float column is whole (only then are they
    printed as integers); without it each value is judged alone.
    """
    if isinstance(dtype, _FLOATS):
        d = c.cast("double")
        whole = is_whole(d) if all_whole is None else all_whole
        text = F.when(whole, d.try_cast("bigint").cast("string")).otherwise(d.cast("string"))
        text = F.when(~F.isnan(d), text)
    elif isinstance(dtype, T.BooleanType):
        text = boolean_text(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(MISSING))


def is_whole(d: Column) -> Column:
    return (d == F.floor(d)) & (F.abs(d) < F.lit(9e15))


def binary_text(c: Column, dtype: T.DataType) -> Column:
    """``True``/``False`` for booleans and yes/no words, other text lower-cased."""
    if isinstance(dtype, T.BooleanType):
        return boolean_text(c)
    low = F.lower(c.cast("string"))
    out = low
    for word, text in BOOLEAN_WORDS.items():
        out = F.when(low == word, F.lit(text)).otherwise(out)
    return out


def money(c: Column, log_scale: bool = False) -> Column:
    """``$12.50`` to 12.5; with ``log_scale`` its natural logarithm (null when not positive)."""
    v = F.replace(c, F.lit("$"), F.lit("")).try_cast("double")
    return F.ln(v) if log_scale else v


def equals_flag(c: Column, flag: str = "ONLINE") -> Column:
    """False, not null, where the value is missing."""
    return F.coalesce(c == F.lit(flag), F.lit(False))


def without_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def without_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a column named inside a lambda is inlined into it and computed per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clock_timestamp(year: Column, month: Column, day: Column, time: Column | None = None,
                    hour: Column | None = None, minute: Column | None = None) -> Column:
    """Timestamp from date parts and ``HH:MM`` text, else hour/minute columns, else midnight.

    Parts that are missing, no numbers or out of range give null; count nulls to find such rows.
    """
    zero = F.lit(0)
    if time is not None:
        parts = F.split(time, ":")
        hour, minute = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    as_int = lambda c: (zero if c is None else c).try_cast("int")
    return F.call_function("try_make_timestamp_ntz", as_int(year), as_int(month), as_int(day),
                           as_int(hour), as_int(minute), F.lit(0).cast("decimal(8,6)"))


def epoch_timestamp(seconds: Column) -> Column:
    """Zone-free timestamp of epoch seconds, whatever the session zone is."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def compact_timestamp(c: Column) -> Column:
    """``21OCT17:00:00:00`` style text; unreadable text becomes null.

    Two-digit years from 69 on lie in the last century, as in C's ``%y``.
    """
    ts = F.try_to_timestamp(c, F.lit("ddMMMyy:HH:mm:ss")).cast("timestamp_ntz")
    return F.when(F.year(ts) >= 2069, ts - F.make_ym_interval(F.lit(100))).otherwise(ts)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    return F.unix_timestamp(ts.cast("timestamp_ntz"))


def epoch_minutes(ts: Column) -> Column:
    """Whole minutes since 1970 of a zone-free timestamp."""
    return F.floor(epoch_seconds(ts) / 60).cast("bigint")


def last_chars(c: Column, n: int = 5) -> Column:
    return F.right(c, F.lit(n))


def joined(cols: list[Column], sep: str = "_", null_text: str = "nan") -> Column:
    """Join columns as text; a null prints as ``null_text`` instead of vanishing."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit(null_text)) for c in cols])


def mapped(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Relabel values; values outside the mapping become ``default`` (null when not given)."""
    out = default if default is not None else F.lit(None)
    for old, new in reversed(list(mapping.items())):
        out = F.when(c == F.lit(old), F.lit(new)).otherwise(out)
    return out


def uniform(*parts: Column, slot: int = 0) -> Column:
    """Reproducible number in [0, 1) from the md5 of the parts, in 32-bit steps.

    ``slot`` 0-3 picks one of four independent 8-digit groups of the same digest. Unlike
    ``rand`` the value depends on the row alone, so retries and repartitioning keep it.
    """
    return uniform_of(digest(*parts), slot)


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def uniform_of(hex_digest: Column, slot: int = 0) -> Column:
    word = F.substring(hex_digest, 1 + 8 * slot, 8)
    return F.conv(word, 16, 10).cast("double") / F.lit(4294967296.0)


def drawn_below(hex_digest: Column, share: float, slot: int = 0) -> Column:
    """Whether ``uniform_of(hex_digest, slot) < share``, by comparing hex digits as text.

    Inside array lambdas this is several times cheaper than turning the digits into a number.
    """
    limit = math.ceil(share * 4294967296)
    if limit <= 0 or limit > 0xFFFFFFFF:
        return F.lit(limit > 0)
    return F.substring(hex_digest, 1 + 8 * slot, 8) < F.lit(f"{limit:08x}")
