"""Cells to tokens, rows to text, corpora to vocabularies, tokens to ids and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tributary.functions.columns import boolean_text, bound, quoted, without_whitespace
from tributary.functions.local import local_table
from tributary.operators.cumulative import running_total
from tributary.schema import EventSchema

ROW = "[ROW]"
PAD, BOS, EOS, MASK, UNK = "[PAD]", "[BOS]", "[EOS]", "[MASK]", "[UNK]"
# The special tokens in id order.
SPECIALS = [PAD, BOS, EOS, MASK, UNK]
PAD_ID, BOS_ID, EOS_ID, MASK_ID, UNK_ID = range(5)
# Special tokens of the insertion-ordered vocabulary.
INSERTION_SPECIALS = [UNK, PAD, BOS, EOS]
VOCABULARY_SIZE = 60_000
# A vocabulary up to this size is broadcast or held as one array.
BROADCAST_WORDS = 1_000_000
TOKEN_PATTERN = r"^(\d+)_(.*)$"


def number_text(c: Column) -> Column:
    """A double as plain text from 0.0001 up to 10 to the 16th, beyond that with an exponent of two digits at least."""
    size = F.abs(c)
    java = c.cast("string")
    # A double has at most 17 digits, so nothing is cut by the scale.
    plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), "0+$", ""), "[.]$", ".0")
    sign, power = F.regexp_extract(java, "E(-?)", 1), F.regexp_extract(java, "E-?([0-9]+)", 1)
    short = F.concat(F.regexp_replace(F.regexp_extract(java, "^([^E]*)", 1), "[.]0$", ""), F.lit("e"), F.when(sign == "-", "-").otherwise("+"),
                     F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    spelt = (size < 1e-3) & (size >= 1e-4) | (size >= 1e7) & (size < 1e16)
    return F.when(F.isnan(c), F.lit("nan")).when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(
        spelt, plain).when(java.contains("E"), short).otherwise(java)


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text; booleans print True/False, doubles as ``number_text``, and null prints as nan."""
    c, kind = quoted(name), df.schema[name].dataType
    text = boolean_text(c) if isinstance(kind, T.BooleanType) else number_text(c) if isinstance(kind, T.DoubleType) else c.cast("string")
    return F.coalesce(text, F.lit("nan"))


def cell_tokens(df: DataFrame, schema: EventSchema, use_name: bool = False) -> DataFrame:
    """Prefix every data cell with its column id (``3_x``) or its name (``amount:x``)."""
    prefix = {c: f"{c}:" if use_name else f"{i}_" for c, i in schema.col_ids.items()}
    return df.withColumns({c: F.concat(F.lit(p), cell_text(df, c)) for c, p in prefix.items()})


def token_array(df: DataFrame, schema: EventSchema, row_token: str = ROW) -> Column:
    return F.array(*map(quoted, schema.data_cols), F.lit(row_token))


def row_text(tokens: DataFrame, schema: EventSchema, row_token: str = ROW, strip: bool = False) -> Column:
    """Tokens of a row joined by a space, closed by the row marker."""
    cells = [without_whitespace(quoted(c)) if strip else quoted(c) for c in schema.data_cols]
    return F.concat_ws(" ", *cells, F.lit(row_token))


def named_row_text(df: DataFrame, schema: EventSchema) -> DataFrame:
    """Readable rows: ``name:value`` tokens without any whitespace inside, numbers unbucketed."""
    named = cell_tokens(df, schema, use_name=True)
    return named.withColumn("text", row_text(named, schema, strip=True))


def with_separators(df: DataFrame, cols: list[str], col_sep: str | None = "COL",
                    row_sep: str | None = "ROW", out: str = "tokens") -> DataFrame:
    """Cells with a separator after each one, the last included, and a row separator."""
    cells: list[Column] = []
    for c in cols:
        cells.append(cell_text(df, c))
        if col_sep is not None:
            cells.append(F.lit(col_sep))
    if row_sep is not None:
        cells.append(F.lit(row_sep))
    return df.withColumn(out, F.array(*cells))


def composite_token(df: DataFrame, schema: EventSchema, out: str = "tokens") -> DataFrame:
    """All data cells of a row as one word, beside the index and label columns."""
    word = F.concat_ws("_", *[cell_text(df, c) for c in schema.data_cols])
    keep = dict.fromkeys([*schema.index, *schema.label])
    return df.select(*map(quoted, keep), word.alias(out))


def atomic_layout(df: DataFrame, schema: EventSchema) -> DataFrame:
    """Index, data and label columns side by side; a label that is also data appears again
    under ``label_<name>``."""
    labels = [quoted(c).alias(f"label_{c}") for c in schema.label]
    return df.select(*map(quoted, schema.index), *map(quoted, schema.data_cols), *labels)


def records(df: DataFrame, schema: EventSchema, sep: str = " ", keep: list[str] = ()) -> DataFrame:
    """(metadata struct, text, labels struct) per row."""
    return df.select(
        *map(quoted, keep),
        F.struct(*map(quoted, schema.index)).alias("metadata"),
        F.concat_ws(sep, *[cell_text(df, c) for c in schema.data_cols]).alias("text"),
        F.struct(*map(quoted, schema.label)).alias("labels"))


def words_in_order(df: DataFrame, row: list[str], cols: list[str], second: DataFrame | None = None,
                   second_cols: list[str] | None = None) -> DataFrame:
    """One word per line, (row, source, column) giving its place.

    Rows of a second table follow the rows of the first that have the same row key. Sort by the
    three columns on output; sorting here would only be lost at the next shuffle.
    """

    def words(t: DataFrame, names: list[str], src: int) -> DataFrame:
        cells = F.array(*[cell_text(t, c) for c in names])
        return t.select(*map(quoted, row), F.lit(src).alias("src"),
                        F.posexplode(cells).alias("col_ix", "word"))

    out = words(df, cols, 0)
    if second is not None:
        out = out.unionByName(words(second, second_cols or cols, 1))
    return out


def _numbered(words: DataFrame, first: int) -> DataFrame:
    # The input was cut to the vocabulary size, so this sort is small by construction.
    w = W.orderBy(F.desc("freq"), "token")
    return words.select("token", (F.row_number().over(w) + F.lit(first - 1)).cast("int").alias("id"), "freq")


def _with_parts(vocabulary: DataFrame) -> DataFrame:
    """Column id and value of each token, split at the first underscore."""
    col = F.regexp_extract("token", TOKEN_PATTERN, 1)
    return vocabulary.select(
        "token", "id", F.when(col != "", col).cast("int").alias("col_id"),
        F.when(col != "", F.regexp_extract("token", TOKEN_PATTERN, 2)).alias("value"), "freq")


def fit_vocabulary(tokens: DataFrame, words: Column, size: int = VOCABULARY_SIZE) -> DataFrame:
    """Special tokens, then the most frequent words; equal counts order by word.

    ``words`` is an array of tokens per row. Counting is pre-aggregated, so the row marker that
    closes every row costs one partial count per task.
    """
    counts = (tokens.select(F.explode(words).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    counts = counts.where(~F.col("token").isin(SPECIALS))
    top = counts.orderBy(F.desc("freq"), "token").limit(size - len(SPECIALS))
    special = local_table(
        tokens.sparkSession, [(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, freq bigint")
    return _with_parts(special.unionByName(_numbered(top, len(SPECIALS))))


def fit_column_vocabulary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Insertion-ordered vocabulary: special tokens, then the distinct values column by column.

    A value seen in an earlier column keeps that id. There is no limit: numbers are running totals over ordered ranges.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("col_ix"), cell_text(df, c).alias("token"))
                      for i, c in enumerate(cols)])
    values = (df.select(F.explode(pairs).alias("p")).select("p.col_ix", "p.token")
              .where(~F.col("token").isin(INSERTION_SPECIALS))
              .groupBy("token").agg(F.min("col_ix").alias("col_ix"), F.lit(1).cast("bigint").alias("one")))
    ids = running_total(values, ["col_ix", "token"], "one", "place")
    number = F.col("place") + F.lit(len(INSERTION_SPECIALS) - 1)
    special = local_table(
        df.sparkSession, [(t, i) for i, t in enumerate(INSERTION_SPECIALS)], "token string, id int")
    return special.unionByName(ids.select("token", number.cast("int").alias("id")))


def encode_rows(tokens: DataFrame, cols: list[str], vocabulary: DataFrame, out: str = "input_ids",
                row_token: str = ROW, unknown: int = UNK_ID) -> DataFrame:
    """Replace the tokens of each row by an array of ids, the row marker last.

    A vocabulary of at most ``BROADCAST_WORDS`` entries is broadcast; every column probes the same broadcast table and the events
    are never shuffled. A larger one is joined as Spark sees fit, with the same result.
    """
    words = vocabulary.select("token", "id")
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    ids = []
    df = tokens
    for i, c in enumerate(cols):
        side = words.toDF(f"__t{i}", f"__i{i}")
        df = df.join(F.broadcast(side) if few else side, quoted(c) == F.col(f"__t{i}"), "left").drop(f"__t{i}")
        ids.append(F.coalesce(F.col(f"__i{i}"), F.lit(unknown)))
    marker = words.where(F.col("token") == row_token).agg(F.max("id")).scalar()
    ids.append(F.coalesce(marker, F.lit(unknown)))
    rest = [quoted(c) for c in tokens.columns if c not in cols]
    return df.select(*rest, F.array(*ids).alias(out))


def pinned(vocabulary: DataFrame) -> DataFrame:
    """Compute a fitted vocabulary once and keep it as a local table.

    A vocabulary has at most its configured size in rows (60,000 by default), so holding it on
    the driver is bounded; without this every plan that encodes would count the words again.
    """
    return vocabulary.sparkSession.createDataFrame(vocabulary.toArrow(), vocabulary.schema)


def decode_ids(df: DataFrame, vocabulary: DataFrame, key: list[str], ids: str = "input_ids",
               out: str = "tokens", unknown: str = UNK) -> DataFrame:
    """Arrays of ids back to arrays of tokens; unknown ids become ``[UNK]``.

    ``key`` identifies an array. Ids count from 0, so the tokens of a vocabulary of at most ``BROADCAST_WORDS`` entries are one array
    in which each id is a place, and no row moves. With a larger one ids are looked up one per line and gathered per key again.
    """
    if vocabulary.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        listed = vocabulary.agg(F.array_sort(F.collect_list(F.struct("id", "token")))).scalar()
        found = lambda names, i: F.when(F.get(names, i)["id"] == i, F.get(names, i)["token"])
        words = bound(F.col("__names"), lambda names: F.transform(quoted(ids), lambda i: F.coalesce(found(names, i), F.lit(unknown))))
        return df.withColumn("__names", listed).select(*map(quoted, key), words.alias(out))
    lines = df.select(*map(quoted, key), F.posexplode(ids).alias("__p", "__id"))
    names = vocabulary.select(F.col("id").alias("__vid"), F.col("token").alias("__token"))
    known = lines.join(names, F.col("__id") == F.col("__vid"), "left")
    pairs = F.struct("__p", F.coalesce("__token", F.lit(unknown)).alias("t"))
    return (known.groupBy(*map(quoted, key)).agg(F.array_sort(F.collect_list(pairs)).alias("__a"))
            .select(*map(quoted, key), F.col("__a.t").alias(out)))


def tokens_by_column(vocabulary: DataFrame) -> DataFrame:
    """(col_id, value, id) of every column token."""
    return vocabulary.where(F.col("col_id").isNotNull()).select("col_id", "value", "id")


def label_options(vocabulary: DataFrame, label_col: int | None = None) -> DataFrame:
    """Number of column prefixes, the label column (the highest prefix unless given) and the
    ids of its values, one row per value."""
    cols = tokens_by_column(vocabulary)
    facts = cols.agg(F.struct(F.count_distinct("col_id").alias("n"), F.max("col_id").alias("last"))).scalar()
    label = F.lit(label_col) if label_col is not None else facts.getField("last")
    return cols.where(F.col("col_id") == label).select(
        facts.getField("n").alias("num_cols"), F.col("col_id").alias("label_col"), "value", "id")


def vocabulary_metrics(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count(F.lit(1)).alias("vocab_size"), (F.count(F.lit(1)) > 0).alias("is_initialized"))

