"""Numbered, encoded events to fixed-length training sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import digest, quoted
from tributary.operators.tokens import BOS_ID, EOS_ID, PAD_ID

IGNORE = -100
NO_COLUMN = -1


def chunk_index(pos: Column, length: int) -> Column:
    """0-based chunk of a 1-based ordinal."""
    return F.floor((pos - 1) / F.lit(length)).cast("int")


def column_order(n_cols: int, fixed: int, label: int | None, moved_to: int | None,
                 *key: Column) -> Column:
    """Reproducible order of the columns of one event, as an array of column positions.

    The last ``fixed`` columns and the row marker stay in place. With ``moved_to`` the label
    column is taken out of the shuffle and put at that position.
    """
    free = list(range(n_cols - fixed - 1))
    if moved_to is not None:
        if label not in free or moved_to not in free:
            raise ValueError("the label and its new position must be among the free columns")
        free.remove(label)
    drawn = F.array_sort(F.array(*[
        F.struct(digest(*key, F.lit(i)).alias("h"), F.lit(i).alias("c")) for i in free])).getField("c")
    if moved_to is not None:
        drawn = F.array_insert(drawn, F.lit(moved_to + 1), F.lit(label))
    return F.concat(drawn, F.array(*[F.lit(i) for i in range(n_cols - fixed - 1, n_cols)]))


def shuffle_columns(rows: DataFrame, n_cols: int, key: list[str], seed: int, epoch: int = 0,
                    fixed: int = 1, label: int | None = None, moved_to: int | None = None,
                    ids: str = "input_ids", mask: str = "mask") -> DataFrame:
    """Permute the cells of each event before it is put into a sequence.

    Adds ``mask``, the column position of every cell. ``key`` (entity and ordinal) with seed and
    epoch decides the order, so it can be repeated for a new epoch without storing anything.
    """
    order = column_order(n_cols, fixed, label, moved_to, F.lit(seed), F.lit(epoch), *map(quoted, key))
    ordered = rows.withColumn(mask, order)
    cells = F.array(*[F.element_at(ids, F.element_at(mask, F.lit(i + 1)) + F.lit(1)) for i in range(n_cols)])
    return ordered.withColumn(ids, cells)


def sequences(rows: DataFrame, entity: str, length: int, n_cols: int, pos: str = "pos",
              ids: str = "input_ids", mask: str | None = None, keep: list[str] = (),
              pad: int = PAD_ID, bos: int | None = BOS_ID, eos: int | None = EOS_ID) -> DataFrame:
    """Chunks of ``length`` consecutive events per entity, flattened, padded and wrapped.

    A group holds at most ``length`` events, however many the entity has. ``keep`` names columns
    that are constant per entity, the split for one. Missing begin/end ids fall back to the pad.
    """
    parts = [quoted(pos).alias("p"), quoted(ids).alias("i")]
    if mask:
        parts.append(quoted(mask).alias("m"))
    groups = (rows.withColumn("seq_idx", chunk_index(quoted(pos), length))
              .groupBy(quoted(entity), "seq_idx", *map(quoted, keep))
              .agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("__rows")))
    n = F.size("__rows")
    padding = (F.lit(length) - F.col("n_rows")) * F.lit(n_cols)
    flat_mask = (F.flatten(F.col("__rows.m")) if mask else
                 F.flatten(F.array_repeat(F.array(*[F.lit(i) for i in range(n_cols)]), F.col("n_rows"))))
    wrap = lambda first, body, last: F.concat(F.array(F.lit(first)), body, F.array(F.lit(last)))
    return groups.withColumn("n_rows", n).select(
        quoted(entity), "seq_idx", *map(quoted, keep), "n_rows",
        wrap(pad if bos is None else bos,
             F.concat(F.flatten(F.col("__rows.i")), F.array_repeat(F.lit(pad), padding)),
             pad if eos is None else eos).alias("input_ids"),
        wrap(NO_COLUMN, F.concat(flat_mask, F.array_repeat(F.lit(NO_COLUMN), padding)), NO_COLUMN).alias("mask"))


def text_sequences(rows: DataFrame, entity: str, length: int, pos: str = "pos", text: str = "text",
                   keep: list[str] = ()) -> DataFrame:
    """Row texts of each chunk joined by a space; a short tail is kept as it is."""
    pairs = F.struct(quoted(pos).alias("p"), quoted(text).alias("t"))
    return (rows.withColumn("seq_idx", chunk_index(quoted(pos), length))
            .groupBy(quoted(entity), "seq_idx", *map(quoted, keep))
            .agg(F.array_sort(F.collect_list(pairs)).alias("__rows"))
            .select(quoted(entity), "seq_idx", *map(quoted, keep), F.size("__rows").alias("n_rows"),
                    F.array_join(F.col("__rows.t"), " ").alias("text")))


def next_token_labels(ids: Column, pad: int = PAD_ID) -> Column:
    """Ids shifted left by one; the result is one shorter than the input."""
    return same_length_labels(F.slice(ids, F.lit(2), F.size(ids) - 1), pad)


def same_length_labels(ids: Column, pad: int = PAD_ID) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(IGNORE)).otherwise(x))


def attention(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != 0).cast("int"))


def wide_events(rows: DataFrame, entity: str, length: int, features: list[str], pos: str = "pos") -> DataFrame:
    """One row per full chunk with columns ``Event i.feature``; incomplete chunks are dropped."""
    cells = [F.max(F.when(F.col("__slot") == i, quoted(f))).alias(f"Event {i}.{f}")
             for i in range(1, length + 1) for f in features]
    return (rows.withColumn("seq_idx", chunk_index(quoted(pos), length))
            .withColumn("__slot", (quoted(pos) - 1) % F.lit(length) + 1)
            .groupBy(quoted(entity), "seq_idx").agg(F.count(F.lit(1)).alias("__n"), *cells)
            .where(F.col("__n") == length).drop("__n"))
