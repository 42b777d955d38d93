"""What the operators of this subpackage share: shared scratch tables, size-checked broadcasts, word hashes.

Hashes are polynomial sums modulo 2**64 over whole Arrow buffers: every byte has a random 64-bit value, a word's hash is the
difference of two prefix sums, a window's hash is the same over word hashes. Two texts with the same words have the same
hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.shared import remove, shared_folder

#: Most rows a table may have to be broadcast by hint; rows here are a few longs, so this is some tens of megabytes.
BROADCAST_ROWS = 500_000
#: Bytes of a row group of scratch tables: writers of wide rows hold one per core.
ROW_GROUP = 16 << 20
#: Text bytes that are hashed at once; a longer text is hashed alone and whole.
CHUNK_BYTES = 1 << 20


#: Rows and bytes of an Arrow batch between Spark and Python, where the session names none: texts are long, so fewer than usual.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session small, unless it has settings of its own."""
    for name, value in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


class Scratch:
    """Tables in the shared folder: they cut lineage and outlive executors. ``drop`` removes tables no longer read."""

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark, self.root = spark, shared_folder(spark)
        self.paths: dict[str, list[str]] = {}
        self.made = 0

    def fresh(self) -> Scratch:
        """Another one: an operator that drops its own tables leaves its caller's alone."""
        return Scratch(self.spark)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def save(self, df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        self.paths.setdefault(name, []).append(path)
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path, partitionBy=partitions)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            remove(self.spark, path)

    def keep(self, *names: str) -> None:
        """Drops all other tables."""
        self.drop(*(self.paths.keys() - set(names)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that Spark joins by a shuffle, with the same result."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame, text_col: str, identity: list[str], carry: list[str] | None = None) -> DataFrame:
    """Columns row (a struct of the columns ``carry``, default all), text (null: empty) and a 128-bit key (r1, r2) of the identity
    columns and the text, never null. Rows with one key are equal in both, so each step may treat them alike."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*carry) if carry else F.struct("*")
    return docs.select(row.alias("row"), text.alias("text"), F.xxhash64(*identity, text).alias("r1"),
                       F.xxhash64(text, *identity, F.lit(1)).alias("r2"))


def one_of_each(rows: DataFrame, *key: str) -> DataFrame:
    """Column row of one row for each value of the columns ``key``, by a hash of its columns; repeated rows meet in map-side partial results."""
    return rows.groupBy(*key).agg(F.max_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")


#: Odd multipliers and seeds of the hashes.
WORD_STEP, WINDOW_STEP, SECOND_STEP = 0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F | 3
SEED = 20_240_607


@cache
def byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are white space (0x20, 0x09 to 0x0D); bytes with A-Z lower-cased."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


#: Values that are hashed at once: tables of powers and what is summed up in between have this size, whatever the length of a text.
HASH_BLOCK = 1 << 16


@cache
def powers(step: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i modulo 2**64 for i below HASH_BLOCK."""
    both = []
    for base in (step, pow(step, -1, 1 << 64)):
        x = np.full(HASH_BLOCK, base, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x, dtype=np.uint64))
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, step: int, table: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[start:end], the same wherever the range stands; starts and ends ascend. With ``table`` the values are its entries at
    ``values``. Sums run block by block and only stay where a range begins or ends."""
    up, down = powers(step)
    places, sums = (start, end), (np.zeros(len(start), np.uint64), np.zeros(len(end), np.uint64))
    total = np.uint64(0)
    for begin in range(0, len(values), HASH_BLOCK):
        part = values[begin:begin + HASH_BLOCK]
        scale = np.uint64(pow(step, begin, 1 << 64))
        part = np.cumsum((part if table is None else table[part]) * up[: len(part)], dtype=np.uint64) * scale + total
        for at, out in zip(places, sums, strict=True):
            f, t = np.searchsorted(at, (begin + 1, begin + len(part) + 1))
            out[f:t] = part[at[f:t] - begin - 1]
        total = part[-1]
    back = np.array([pow(step, -i, 1 << 64) for i in range(0, len(values) + 1, HASH_BLOCK)], np.uint64)
    return mix((sums[1] - sums[0]) * down[start % HASH_BLOCK] * back[start // HASH_BLOCK])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: ``hashes``, byte ranges ``start`` and ``end`` in ``data``, and the first word
    of each text in ``first`` (one more entry than texts)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        space, lowered = byte_tables()
        self.data = data = lowered[data] if lower else data
        ink = ~space[data]
        edge = ink.copy()
        if len(data):
            full = np.flatnonzero(offsets[1:] > offsets[:-1])
            edge[1:] &= ~ink[:-1]
            edge[offsets[full]] = ink[offsets[full]]
            self.start = np.flatnonzero(edge)
            edge[:] = ink
            edge[:-1] &= ~ink[1:]
            edge[offsets[full + 1] - 1] = ink[offsets[full + 1] - 1]
        else:
            self.start = np.empty(0, np.int64)
        self.end = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = ranges(data, self.start, self.end, WORD_STEP, byte_values())

    def windows(self, n: int, step: int = WINDOW_STEP) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as words of all texts) of windows of ``n`` words that stay in one text, and their hashes."""
        count = np.diff(self.first)
        left = np.repeat(self.first[1:], count) - np.arange(len(self.hashes))
        starts = np.flatnonzero(left >= n)
        return starts, ranges(self.hashes, starts, starts + n, step)


def text_rows(docs: DataFrame, text_col: str, carry: list[str] | None) -> DataFrame:
    """Column row (a struct of the columns ``carry``, default all) and, unless row holds it, text: Python reads a text that is carried
    along anyway out of row (see ``chunks``), so it is sent once."""
    row = F.struct(*carry) if carry else F.struct("*")
    return docs.select(row.alias("row"), *([] if not carry else [F.col(text_col).alias("text")]))


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES, inside: str | None = None) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``limit`` text bytes, null texts as empty ones. Where the batch has no column ``text``, it is the field
    ``inside`` of row."""
    at = batch.schema.get_field_index(text)
    column = batch.column(at) if at >= 0 else pc.struct_field(batch.column("row"), [[f.name for f in batch.schema.field("row").type].index(inside)])
    column = column.cast(pa.large_string()).fill_null("")
    batch = batch.set_column(at, pa.field(text, pa.large_string()), column) if at >= 0 else batch.append_column(pa.field(text, pa.large_string()), column)
    sizes = np.cumsum(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), np.int64)) if len(column) else np.empty(0, np.int64)
    begin = 0
    while begin < len(column):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
