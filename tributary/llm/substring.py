"""Removal of long repeated word spans through a compacted De Bruijn graph of sampled k-mers.

Anchors are k-mers of words that have the smallest hash of all k-mers of some window; a window that occurs twice has the same anchor
both times. Successive anchors of a text are the edges of a De Bruijn graph, labelled with the words between. Anchors that occur
once leave the graph. A link between two anchors is nonbranching when all occurrences of both agree on it. Joins find such links
and bring them to the occurrences of their anchors; all occurrences of a linked anchor follow the same anchors up to the first one of the
path, so each text then holds its paths (unitigs) whole and compacts them by itself. In a unitig every window is repeated: every place
of it is checked against the others by a 128-bit hash of its whole span, and links whose spans differ anywhere (labels are 64 bits)
are cut. All other windows over a repeated anchor go to an exact count, by 96-bit hashes and with their source coordinates. Those
never equal a window inside a unitig: both would hold the same anchor, and all occurrences of a linked anchor agree on
what surrounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import SECOND_STEP, Scratch, Words, chunks, keyed, ranges, small

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 35, 12
#: Rows of one long each that a table may have to be broadcast: 16 MB. A larger one is joined by a shuffle.
LONGS = 2_000_000
TOP = np.uint64(2**64 - 1)


def sliding(best, x: np.ndarray, n: int) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every n successive values."""
    width = 1
    while 2 * width <= n:
        x = best(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return best(x[:-rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


class Sampled:
    """Anchors of some texts: per word the hash of the k-mer that starts there, per word the least one of its window."""

    def __init__(self, words: Words, window: int, anchor: int):
        n, self.words = len(words.hashes), words
        span = window - anchor + 1
        self.kmers = np.full(n, TOP)
        starts, hashes = words.windows(anchor)
        self.kmers[starts] = hashes
        self.starts, _ = words.windows(window) if n >= window else (np.empty(0, np.int64), None)
        self.least = np.zeros(n, np.uint64)
        if len(self.starts):
            self.least[self.starts] = sliding(np.minimum, self.kmers, span)[self.starts]
        cover = sliding(np.maximum, np.concatenate([np.zeros(span - 1, np.uint64), self.least]), span)
        self.anchors = np.flatnonzero((cover == self.kmers) & (self.kmers != TOP) & (cover > 0))


def anchor_rows(window: int, anchor: int, labels: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                found = Sampled(words, window, anchor)
                at = found.anchors
                doc = np.searchsorted(words.first, at, side="right") - 1
                follows = np.zeros(len(at), bool)
                follows[:-1] = doc[:-1] == doc[1:]
                after = np.where(follows, np.roll(at, -1), -1)
                out = np.zeros(len(at), np.uint64)
                if follows.any():
                    out[follows] = ranges(words.hashes, at[follows], after[follows] + anchor, SECOND_STEP) & np.uint64((1 << labels) - 1) | np.uint64(1)
                base = words.first[doc]
                yield pa.record_batch([part.column("r1").take(pa.array(doc)), part.column("r2").take(pa.array(doc)),
                                       pa.array((at - base).astype(np.int32)), pa.array(np.where(follows, after - base, -1).astype(np.int32)),
                                       pa.array(found.kmers[at].view(np.int64)), pa.array(out.view(np.int64))],
                                      names=["r1", "r2", "pos", "next_pos", "h", "out"])
    return rows


ANCHOR_SCHEMA = "r1 long, r2 long, pos int, next_pos int, h long, out long"


class Candidates:
    """Of texts with their repeated anchors: word ranges ``inner`` inside unitigs, and starts of other windows that may be repeated."""

    def __init__(self, part: pa.RecordBatch, window: int, anchor: int):
        self.words = words = Words(part.column("text"))
        n, sampled, lists = len(words.hashes), Sampled(words, window, anchor), part.column("anchors")
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, doc = lists.flatten(), np.repeat(np.arange(len(part)), size)
        at = words.first[doc] + flat.field("pos").to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        at, doc = at[order], doc[order]
        follows = flat.field("linked").to_numpy(zero_copy_only=False)[order].astype(bool)
        joined = np.zeros(len(at), bool)
        joined[:-1] = follows[1:] & (doc[:-1] == doc[1:])  # a linked anchor always has its predecessor before it
        before = np.concatenate([[False], joined[:-1]]) if len(at) else joined
        begin, end = at[np.flatnonzero(joined & ~before)], at[np.flatnonzero(~joined & before)] + anchor
        long = end - begin >= window
        self.inner, self.heads = (begin[long], end[long]), sampled.kmers[begin[long]]
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, begin[long], 1)
        np.add.at(inside, end[long] - window + 1, -1)
        inside = np.cumsum(inside)[:n] > 0
        repeated = np.zeros(n, bool)
        repeated[at] = True
        self.starts = sampled.starts
        if len(self.starts):
            least = sliding(np.minimum, np.where(repeated, sampled.kmers, TOP), window - anchor + 1)
            self.starts = self.starts[(least[self.starts] == sampled.least[self.starts]) & ~inside[self.starts]]
        self.doc = np.searchsorted(words.first, self.starts, side="right") - 1


def window_rows(window: int, anchor: int):
    """Windows to be counted (span false): the text's number, the first word, and 96 bits of hash as k1 and k2. Places of unitigs (span true):
    the same, with the hash of the first anchor as k1 and 128 bits of the whole span as v1 and v2."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = Candidates(part, window, anchor)
                starts, words, (begin, end) = found.starts, found.words, found.inner
                one, two = (ranges(words.hashes, starts, starts + window, x) for x in (SECOND_STEP, SECOND_STEP + 8))
                whole = [ranges(words.hashes, begin, end, x).view(np.int64) for x in (SECOND_STEP + 16, SECOND_STEP + 24)]
                doc = np.concatenate([found.doc, np.searchsorted(words.first, begin, side="right") - 1])
                at = np.concatenate([starts, begin])
                none, span = np.zeros(len(starts), np.int64), np.arange(len(at)) >= len(starts)
                keys = [one.view(np.int64), (two >> np.uint64(32)).astype(np.int64)], [found.heads.view(np.int64), np.zeros(len(begin), np.int64)]
                yield pa.record_batch([part.column("rid").take(pa.array(doc)), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(span),
                                       *(pa.array(np.concatenate(x)) for x in zip(*keys, strict=True)), *(pa.array(np.concatenate([none, x])) for x in whole)],
                                      names=["rid", "start", "span", "k1", "k2", "v1", "v2"])
    return rows


WINDOW_SCHEMA = "rid long, start int, span boolean, k1 long, k2 long, v1 long, v2 long"


def without(part: pa.RecordBatch, words: Words, gone: np.ndarray, as_is: bool) -> pa.RecordBatch:
    """Every row with its number of words, of removed words, and the other words joined by one space."""
    data, sums = words.data.copy(), np.concatenate([[0], np.cumsum(~gone)])
    have = sums[words.first[1:]] - sums[words.first[:-1]]
    which = np.flatnonzero(~gone)
    doc = np.searchsorted(words.first, which, side="right") - 1
    last = np.ones(len(which), bool)
    last[:-1] = doc[:-1] != doc[1:]
    mask = np.zeros(len(data) + 1, np.int8)
    mask[words.start[which]] = 1
    np.add.at(mask, words.end[which], -1)
    mask = np.cumsum(mask, dtype=np.int8)[:-1].astype(bool)
    gap = words.end[which[~last]]
    mask[gap], data[gap] = True, 0x20
    length = np.zeros(len(part), np.int64)
    np.add.at(length, doc, words.end[which] - words.start[which] + ~last)
    offsets = np.concatenate([[0], np.cumsum(length)])
    text = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(data[mask]))
    total = np.diff(words.first)
    if as_is:
        text = pc.if_else(pa.array(total == have), part.column("text"), text)
    return pa.record_batch([part.column("row"), pa.array(total), pa.array(total - have), text.cast(pa.string())],
                           names=["row", "n_words", "n_removed", "kept"])


def untouched_rows(as_is: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                yield without(part, words, np.zeros(len(words.hashes), bool), as_is)
    return rows


def kept_rows(window: int, anchor: int, as_is: bool):
    """Candidates again, without the windows that were counted once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = Candidates(part, window, anchor)
                words, once = found.words, part.column("once")
                size = once.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                single = words.first[np.repeat(np.arange(len(part)), size)] + once.flatten().to_numpy(zero_copy_only=False)
                starts = np.setdiff1d(found.starts, single, assume_unique=True)
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                for begin, end in (found.inner, (starts, starts + window)):
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, end, -1)
                yield without(part, words, np.cumsum(cover)[:-1] > 0, as_is)
    return rows


def occurrences(anchors: DataFrame) -> DataFrame:
    """Repeated anchors by text: an ordered array, without the copies that equal rows add."""
    return anchors.groupBy("r1", "r2").agg(F.sort_array(F.collect_set(F.struct("pos", "next_pos", "h", "out"))).alias("a"))


def edges(found: DataFrame) -> DataFrame:
    """One row per anchor occurrence with the labels of its edges (0: none, or to an anchor that occurs once)."""
    at = F.posexplode("a").alias("i", "x")
    x = found.select("r1", "r2", "a", at)
    after, before = F.get("a", F.col("i") + 1), F.get("a", F.col("i") - 1)
    on = F.coalesce(after["pos"] == F.col("x.next_pos"), F.lit(False))
    back = F.coalesce(before["next_pos"] == F.col("x.pos"), F.lit(False))
    return x.select("r1", "r2", "x.pos", "x.next_pos", "x.h", F.when(on, F.col("x.out")).otherwise(0).alias("out"),
                    F.when(back, before["out"]).otherwise(0).alias("into"), F.when(on, after["h"]).alias("next_h"))


def same(column: str) -> Column:
    return (F.min(column) == F.max(column)) & (F.min(column) != 0)


def linked(nodes: DataFrame) -> DataFrame:
    """(h) of the anchors that a nonbranching link leads to."""
    u, v = nodes.where("out_same").alias("u"), nodes.where("into_same").alias("v")
    return u.join(v, (F.col("u.next_h") == F.col("v.h")) & (F.col("u.out") == F.col("v.into"))).select("v.h")


def without_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW, anchor: int = ANCHOR, carry: list[str] | None = None, as_is: bool = False,
                    labels: int = 64) -> DataFrame:
    """Columns row (the columns ``carry`` of ``docs``, default all), n_words, n_removed and kept (the other words, joined by one space;
    with ``as_is`` a text that loses none is kept as it is).

    A word goes when a window of ``window`` words that covers it also starts elsewhere, in the same text or another one.
    Null and empty texts have no words; shorter texts have no window; all occurrences go, the first one too; equal rows
    each lose all they share; null ids and other columns of any name are carried along; an empty table gives an empty result.
    ``labels`` is the number of bits that tell edges apart before their spans are checked; fewer change the work, not the result.
    """
    scratch = scratch.fresh()
    rows = keyed(docs, text_col, [id_col], carry)
    anchors = scratch.save(rows.select("text", "r1", "r2").mapInArrow(anchor_rows(window, anchor, labels), ANCHOR_SCHEMA), "anchors")
    repeated = scratch.save(anchors.groupBy("h").count().where("count > 1").select("h"), "repeated")
    found = scratch.save(occurrences(anchors.join(small(repeated, LONGS), "h")), "occurrences")
    scratch.drop("anchors")
    steps = edges(found)
    nodes = scratch.save(steps.groupBy("h").agg(
        same("out").alias("out_same"), F.min("out").alias("out"), F.min("next_h").alias("next_h"),
        same("into").alias("into_same"), F.min("into").alias("into")), "nodes")
    links = scratch.save(linked(nodes), "links")
    scratch.drop("repeated", "nodes")
    while True:
        at = steps.join(small(links, LONGS).withColumn("linked", F.lit(True)), "h", "left")
        at = at.select("r1", "r2", F.struct("pos", "h", F.coalesce("linked", F.lit(False)).alias("linked")).alias("x"))
        lists = at.groupBy("r1", "r2").agg(F.collect_list("x").alias("anchors"))
        lists = scratch.save(lists.withColumn("rid", F.monotonically_increasing_id()), "lists")  # numbers hold once written
        keys = small(lists.select("r1", "r2"))
        touched = rows.join(keys, ["r1", "r2"], "left_semi")
        windows = touched.select("text", "r1", "r2").join(lists, ["r1", "r2"]).select("rid", "text", "anchors").mapInArrow(window_rows(window, anchor), WINDOW_SCHEMA)
        sides = [f(c).alias(f"{f.__name__}_{c}") for c in ("v1", "v2") for f in (F.min, F.max)]
        counted = windows.groupBy("span", "k1", "k2").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min("start").alias("start"), *sides)
        differ = "span AND (n = 1 OR min_v1 <> max_v1 OR min_v2 <> max_v2)"
        counted = scratch.save(counted.where(f"NOT span AND n = 1 OR {differ}"), "counted")
        wrong = counted.where(differ).select("rid", "start")
        if wrong.isEmpty():
            break
        # Labels that are equal by chance: the links of these paths go, and their windows are counted one by one.
        inside = lists.join(wrong.dropDuplicates(["rid"]), "rid").select(F.explode("anchors").alias("x")).where("x.linked").select("x.h").distinct()
        links = scratch.save(links.join(small(inside), "h", "left_anti"), "links")
    once = counted.where("NOT span").groupBy("rid").agg(F.collect_list("start").alias("once"))
    marked = scratch.save(lists.join(once, "rid", "left").select("r1", "r2", "anchors", "once"), "marked")
    scratch.keep("lists", "marked")
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType())])
    found = touched.join(marked, ["r1", "r2"]).select("row", "text", "anchors", "once").mapInArrow(kept_rows(window, anchor, as_is), schema)
    return found.unionByName(rows.join(keys, ["r1", "r2"], "left_anti").select("row", "text").mapInArrow(untouched_rows(as_is), schema))
