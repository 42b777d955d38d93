"""Packing of token streams into fixed windows by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.bpe import ByteBpe
from tributary.llm.library import library_tokenizer
from tributary.llm.common import bounded_batches, chunks

#: Tokens of a window. Tokens that are planned together; what is left of a plan's last window starts the next plan.
LENGTH, PLAN = 1024, 1 << 17
#: Lengths below LENGTH that need no padding.
UNPADDED = (64, 128, 256, 512)
#: Penalties in tokens of padding: a window more, a cut at a sentence's end, a cut inside a sentence.
WINDOW_COST, SENTENCE_COST, TORN_COST = 1, 1, 6
#: Sentences longer than this may be torn, at every so many tokens.
LONG_SENTENCE, TEAR = 64, 8


def sentence_ends(bpe: ByteBpe) -> np.ndarray:
    """Per token id whether a sentence may end with it: full stop, exclamation or question mark at its end, or a line break."""
    return np.array([b.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in b for b in bpe.bytes])


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end or begin, 0 first, and the penalty of a cut there."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    at = np.flatnonzero(ends[ids]) + 1
    cost[at] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    for i in np.flatnonzero(gaps > LONG_SENTENCE):
        cost[at[i] + TEAR:at[i + 1]:TEAR] = TORN_COST
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into ``at`` of the cheapest window borders, first and last included.

    The cost of a window is its padding, the penalty of its end and a constant. Over starts in reach, the cheapest one is the
    least of (cost so far + position), as padding falls by one with every position: a queue of rising values gives it in
    constant time. Windows that need no padding are looked up one by one.
    """
    place, penalty = at.tolist(), cost.tolist()
    index = {p: i for i, p in enumerate(place)}
    short = [k for k in UNPADDED if k < length]
    best, back = [0] * len(place), [0] * len(place)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0][1]] < p - length:
            queue.popleft()
        least, start = queue[0]
        least += length - p
        for k in short:
            i = index.get(p - k)
            if i is not None and best[i] < least:
                least, start = best[i], i
        least += penalty[j] + WINDOW_COST
        best[j], back[j] = least, start
        least += p
        while queue and queue[-1][0] >= least:
            queue.pop()
        queue.append((least, j))
    path = [len(place) - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


@dataclass
class Stream:
    """Documents of one task, in order, as tokens not yet packed."""

    ends: np.ndarray
    length: int
    base: int
    windows: int = 0

    def __post_init__(self):
        self.rows, self.ids, self.done, self.total = [], [], [], []

    def add(self, rows: pa.Array, arrays: list[np.ndarray]) -> None:
        self.rows += [rows.slice(i, 1) for i in range(len(rows))]
        self.ids += arrays
        self.done += [0] * len(arrays)
        self.total += [len(a) for a in arrays]

    def size(self) -> int:
        return sum(map(len, self.ids))

    def pack(self, last: bool) -> tuple[list[pa.Array], list[str]]:
        """Pieces of all windows that are settled; with ``last``, of all."""
        ids, sizes = np.concatenate(self.ids), np.array([len(a) for a in self.ids])
        doc_ends = np.cumsum(sizes)
        at, cost = boundaries(ids, doc_ends, self.ends)
        borders = at[cuts(at, cost, self.length)]
        stop = borders[-1] if last else borders[-2]
        windows = borders[:-1] if last else borders[:-2]
        points = np.union1d(np.concatenate([[0], doc_ends]), borders)
        points = points[points <= stop]
        start, end = points[:-1], points[1:]
        doc = np.searchsorted(doc_ends, start, side="right")
        window = np.searchsorted(windows, start, side="right") - 1
        begins = doc_ends - sizes
        raw = np.ascontiguousarray(ids, "<u4")
        crc = [zlib.crc32(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        rows = pa.concat_arrays([self.rows[i] for i in doc.tolist()]) if len(doc) else None
        out = [rows, pa.array(start - begins[doc] + np.array(self.done)[doc]), pa.array(end - start), pa.array(crc, pa.int64()),
               pa.array(np.array(self.total)[doc]), pa.array(self.base + self.windows + window), pa.array(start - windows[window]),
               pa.ListArray.from_arrays(pa.array(np.concatenate([start, [stop]]).astype(np.int32)), pa.array(ids, pa.int32()))]
        self.windows += len(windows)
        keep = int(np.searchsorted(doc_ends, stop, side="right"))
        cut = int(stop - begins[keep]) if keep < len(sizes) else 0
        self.rows, self.ids, self.done, self.total = self.rows[keep:], self.ids[keep:], self.done[keep:], self.total[keep:]
        if cut:
            self.ids[0], self.done[0] = self.ids[0][cut:], self.done[0] + cut
        return out


NAMES = ["row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def packed_rows(path: str, length: int, end_id: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = library_tokenizer(path)
        stream = Stream(sentence_ends(bpe), length, TaskContext.get().partitionId() << 40)
        width = len(NAMES) - (not with_ids)

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            out = stream.pack(last)
            if out[0] is not None:
                yield pa.record_batch(out[:width], names=NAMES[:width])

        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                closing = np.array([end_id], np.int32)
                arrays = [np.concatenate([a, closing]) for a in bpe.encode(part.column("text").to_pylist())]
                group, tokens = 0, 0
                for i, a in enumerate(arrays):
                    tokens += len(a)
                    if tokens >= PLAN or i + 1 == len(arrays):
                        stream.add(part.column("row").slice(group, i + 1 - group), arrays[group:i + 1])
                        group, tokens = i + 1, 0
                        if stream.size() >= PLAN:
                            yield from settled(False)
        if stream.ids:
            yield from settled(True)
    return rows


def packed(docs: DataFrame, path: str, text_col: str = "text", length: int = LENGTH, end_id: int = 0,
           carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: row (the columns ``carry`` of its document, default all), start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, ids.

    Every document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Documents keep the order in which tasks read
    them, each id lies in one piece, pieces of a sequence follow each other without gaps, and a sequence's ids stay unique
    by the task's number. A document longer than a window is cut at sentence ends, a very long sentence inside. Equal rows are
    packed each; null ids and other columns are carried along; an empty table gives an empty result. There is no shuffle; a task
    holds one plan at a time, and the only window that padding cannot avoid is the last one of a task.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select((F.struct(*carry) if carry else F.struct("*")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [T.LongType()] * 6 + [T.ArrayType(T.IntegerType())] * with_ids
    fields = [rows.schema["row"], *(T.StructField(n, k) for n, k in zip(NAMES[1:], kinds, strict=False))]
    return rows.mapInArrow(packed_rows(path, length, end_id, with_ids), T.StructType(fields))
