"""Reproducible masking of sequences. Every draw is a hash of the sequence and the position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import bound, digest, drawn_below, quoted, uniform_of
from tributary.operators.sequence import IGNORE
from tributary.operators.tokens import MASK_ID, SPECIALS


def masked_tokens(seqs: DataFrame, key: list[str], vocab_size: int, seed: int, share: float = 0.15,
                  ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Hide a share of the ordinary tokens: 80 % masked, 10 % a random id, 10 % kept.

    ``labels`` holds the original id at chosen positions and -100 elsewhere. Special and pad
    tokens are never chosen. One digest per token gives all four draws.
    """
    base = F.concat_ws("|", F.lit(seed).cast("string"), *[quoted(k).cast("string") for k in key])
    digests = bound(F.col("__base"), lambda b: F.transform(quoted(ids), lambda x, i: F.when(
        x >= len(SPECIALS), F.md5(F.concat_ws("|", b, i.cast("string"))))))
    cells = F.transform(F.arrays_zip(quoted(ids).alias("x"), F.col("__digests").alias("h")), lambda z: F.struct(
        z["x"].alias("x"), z["h"].alias("h"), F.coalesce(drawn_below(z["h"], share, 0), F.lit(False)).alias("chosen")))
    random_id = lambda d: F.floor(uniform_of(d["h"], 3) * vocab_size).cast("int")
    replaced = lambda d: (F.when(~d["chosen"], d["x"])
                          .when(drawn_below(d["h"], 0.8, 1), F.lit(MASK_ID))
                          .when(drawn_below(d["h"], 0.5, 2), random_id(d)).otherwise(d["x"]))
    return (seqs.withColumn("__base", base).withColumn("__digests", digests).withColumn("__cells", cells)
            .withColumns({ids: F.transform("__cells", replaced),
                          labels: F.transform("__cells", lambda d: F.when(d["chosen"], d["x"]).otherwise(F.lit(IGNORE)))})
            .drop("__cells", "__digests", "__base"))


def label_mask(mask: Column, label: int) -> Column:
    """1 at the cells of the label column, 0 elsewhere."""
    return F.transform(mask, lambda m: (m == label).cast("int"))


def masked_labels(seqs: DataFrame, key: list[str], label: int, n_cols: int, seed: int, mask_all: float,
                  mask_each: float, ids: str = "input_ids", mask: str = "mask", rows: str = "n_rows") -> DataFrame:
    """Hide labels per sequence: all, a random proper subset, or none.

    A draw below ``mask_all`` hides every label; below ``mask_all + mask_each`` it hides 1 to
    c - 1 of the c labels; otherwise, and for the subset case when c < 2, the sequence is
    unchanged. Adds ``n_masked``.
    """
    base = [F.lit(seed), *map(quoted, key)]
    draw = digest(*base)
    c = F.col(rows)
    some = F.least(F.lit(1) + F.floor(uniform_of(F.col("__h"), 1) * (c - 1)), c - 1).cast("int")
    hidden = (F.when(uniform_of(F.col("__h"), 0) < mask_all, c)
              .when((uniform_of(F.col("__h"), 0) < mask_all + mask_each) & (c >= 2), some).otherwise(0))
    text = F.concat_ws("|", *[p.cast("string") for p in base])
    ranks = bound(F.col("__key"), lambda k: F.transform(F.sequence(F.lit(0), c - 1), lambda r: F.struct(
        F.md5(F.concat_ws("|", k, r.cast("string"))).alias("h"), r.alias("r"))))
    picked = F.slice(F.array_sort(ranks), F.lit(1), F.col("n_masked")).getField("r")
    # Position 0 is the begin marker, so event r covers positions r*n_cols+1 ... (r+1)*n_cols.
    cell = bound(F.col("__picked"), lambda hidden_rows: F.transform(
        F.arrays_zip(quoted(ids).alias("x"), quoted(mask).alias("m")),
        lambda z, i: F.when((z["m"] == label) & F.array_contains(hidden_rows, F.floor((i - 1) / n_cols).cast("int")),
                            F.lit(MASK_ID)).otherwise(z["x"])))
    return (seqs.withColumns({"__h": draw, "__key": text})
            .withColumn("n_masked", hidden.cast("int"))
            .withColumn("__picked", picked)
            .withColumn(ids, cell)
            .drop("__h", "__key", "__picked"))


def target_positions(seqs: DataFrame, label: int, mode: str = "labels", mask: str = "mask",
                     out: str = "positions") -> DataFrame:
    """0-based positions the loss counts: every token, the label cells or the last label cell."""
    spots = F.filter(
        F.transform(quoted(mask), lambda m, i: F.when(m == label, i)), lambda p: p.isNotNull())
    if mode == "all":
        positions = F.sequence(F.lit(0), F.size(quoted(mask)) - 1)
    elif mode == "labels":
        positions = spots
    elif mode == "last":
        positions = F.slice(spots, -1, 1)
    else:
        raise ValueError(f"unknown mode {mode}")
    return seqs.withColumn(out, positions)


def without_label_words(text: Column, label: Column) -> Column:
    """Drop the words that start with the label name from a text."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.startswith(w, label))
    return F.array_join(words, " ")
