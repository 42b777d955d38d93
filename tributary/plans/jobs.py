"""The jobs of the pipeline: vocabulary, encoded rows, sequences, text sequences, profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tributary.functions.columns import quoted
from tributary.operators.discretize import MedianCodes, MedianTree, median_codes, stored_codes
from tributary.operators.layout import EntityLayout, with_ordinal
from tributary.operators.sequence import sequences, shuffle_columns, text_sequences
from tributary.operators.split import HashSplit
from tributary.operators.stats import distinct_counts, profile
from tributary.operators.tokens import (VOCABULARY_SIZE, cell_tokens, encode_rows, fit_vocabulary, named_row_text,
                                        pinned, row_text, token_array)
from tributary.plans.datasets import Dataset
from tributary.schema import EventSchema
from tributary.sources.shared import Written


@dataclass
class Encoder:
    """Fitted codes and vocabulary of one event table."""

    schema: EventSchema
    codes: MedianCodes | MedianTree
    vocabulary: DataFrame

    @classmethod
    def fit(cls, events: DataFrame, schema: EventSchema, depth: int = 5,
            size: int = VOCABULARY_SIZE, persist: bool = False) -> "Encoder":
        """Fit thresholds, then the vocabulary over the coded cells: two passes over the events.

        ``persist`` writes the data columns to the shared folder between the passes and deletes them afterwards. Use it when
        ``events`` ends in the gap window, so that the window's shuffle is not repeated; leave it off when ``events`` is
        read from a written table. ``depth`` -1 splits numbers until nothing can be split any more.
        """
        cells = events.select(*map(quoted, schema.data_cols))
        kept = Written(cells) if persist else None
        cells = kept.table if kept else cells
        codes = median_codes(cells, schema.numeric, depth)
        tokens = cell_tokens(codes.transform(cells), schema)
        vocabulary = pinned(fit_vocabulary(tokens, token_array(tokens, schema), size))
        if kept:
            kept.remove()
        return cls(schema, codes, vocabulary)

    def tokens(self, events: DataFrame) -> DataFrame:
        return cell_tokens(self.codes.transform(events), self.schema)

    def text(self, events: DataFrame) -> DataFrame:
        tokens = self.tokens(events)
        return tokens.withColumn("text", row_text(tokens, self.schema))

    def encode(self, events: DataFrame) -> DataFrame:
        """Index and order columns with ``input_ids``, no exchange beyond that of the events."""
        return encode_rows(self.tokens(events), self.schema.data_cols, self.vocabulary)

    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        self.codes.table(spark).write.mode("errorifexists").parquet(f"{path}/thresholds")
        self.vocabulary.write.mode("errorifexists").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str, schema: EventSchema) -> "Encoder":
        return cls(schema, stored_codes(spark.read.parquet(f"{path}/thresholds")),
                   spark.read.parquet(f"{path}/vocabulary"))


def numbered(events: DataFrame, schema: EventSchema, layout: EntityLayout | None = None) -> DataFrame:
    """Events with their ordinal among the events of the sequence key.

    A ``layout`` that was fitted for the gaps serves here too if the entity has no other index column.
    """
    key, order = [schema.sequence_key], schema.order
    if layout is None or (layout.keys, layout.order) != (key, order):
        layout = EntityLayout.fit(events, key, order)
    return with_ordinal(events, layout)


def sequence_table(events: DataFrame, encoder: Encoder, length: int = 10, test_share: float = 0.1,
                   seed: int = 42, randomize: bool = False, epoch: int = 0, fixed: int = 1,
                   label: str | None = None, moved_to: int | None = None, layout: EntityLayout | None = None) -> DataFrame:
    """Normalised events to (entity, seq_idx, split, n_rows, input_ids, mask); ``layout`` as in ``numbered``."""
    schema = encoder.schema
    key = schema.sequence_key
    rows = encoder.encode(numbered(events, schema, layout))
    rows = HashSplit.fit(events, [key], test_share, seed).transform(rows)
    mask = None
    if randomize:
        mask = "mask"
        rows = shuffle_columns(rows, schema.n_cols, [key, "pos"], seed, epoch, fixed,
                               schema.label_position(label), moved_to)
    return sequences(rows, key, length, schema.n_cols, mask=mask, keep=["split"])


def text_table(events: DataFrame, schema: EventSchema, length: int = 10, layout: EntityLayout | None = None) -> DataFrame:
    """Readable rows of each chunk of events as one text."""
    rows = named_row_text(numbered(events, schema, layout), schema)
    return text_sequences(rows, schema.sequence_key, length)


def profile_table(dataset: Dataset, raw: DataFrame, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Distinct counts of the raw table and the role profile of the normalised one."""
    return distinct_counts(raw), profile(dataset.normalise(raw), dataset.schema, depth)
