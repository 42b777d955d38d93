"""Near-duplicates by SetSketch registers, register bands, likelihood estimates and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import SEED, Scratch, Words, chunks, keyed, mix, ranges, small
from tributary.llm.components import components

#: Registers are BANDS groups of ROWS: a pair at similarity 0.8 shares no band once in 300,000 pairs.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base and rate of the exponentially spaced truncation, largest register.
BASE, RATE, MOST = 1.001, 20.0, 65_535
#: Pairs estimated below this are not verified; at similarity 0.8 the estimate's deviation is 0.032.
ESTIMATE = 0.66
#: Members of a bucket, and shingles of them, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1_000, 500_000
TEXT_CHUNK = 1 << 19


@cache
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(SEED + 1))
    return tuple(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (REGISTERS, REGISTERS, ROWS))


def shingle_sets(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and their number per text. A text with fewer words has one shingle,
    its whole sequence; a text without words has none."""
    starts, hashes = words.windows(shingle)
    cut = np.searchsorted(starts, words.first)
    sets = []
    for i, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if e > s:
            sets.append(np.unique(hashes[s:e]))
        else:
            f, t = words.first[i], words.first[i + 1]
            sets.append(ranges(words.hashes[f:t], np.array([0]), np.array([t - f]), 0x5851F42D4C957F2D) if t > f else np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.array([len(x) for x in sets], np.int64)


def registers(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SetSketch registers of every set that is not empty: the least exponential variate of each hash function, truncated to
    a power of BASE. Registers of a union are the maxima of the registers, and equal ones are as frequent as the sets are similar."""
    full = sizes > 0
    begin = (np.cumsum(sizes) - sizes)[full]
    least = np.empty((REGISTERS, int(full.sum())), np.uint64)
    shift, factor, _ = functions()
    work = np.empty_like(flat)
    for i in range(REGISTERS if len(flat) else 0):
        np.bitwise_xor(flat, shift[i], out=work)
        np.multiply(work, factor[i], out=work)
        least[i] = np.minimum.reduceat(work, begin)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, MOST).astype(np.uint16)


def sketch_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", TEXT_CHUNK):
                flat, sizes = shingle_sets(Words(part.column("text"), lower=True), shingle)
                full, ends = sizes > 0, np.cumsum(sizes)
                marks = []
                for seed in (SEED, SEED + 1):
                    sums = np.concatenate([[0], np.cumsum(mix(flat + np.uint64(seed)), dtype=np.uint64)]).astype(np.uint64)
                    marks.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
                names = np.stack(marks, 1).tobytes()
                regs = registers(flat, sizes)
                _, _, factor = functions()
                bands = mix((regs.reshape(-1, BANDS, ROWS).astype(np.uint64) * factor).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                at = np.where(full, np.cumsum(full) - 1, 0)
                raw = regs.tobytes()
                width = REGISTERS * 2
                yield pa.record_batch([
                    part.column("row"), part.column("r1"), part.column("r2"), pa.array(sizes),
                    pa.array([names[16 * i:16 * i + 16] if f else None for i, f in enumerate(full)], pa.binary()),
                    pa.array([raw[width * k:width * (k + 1)] if f else None for k, f in zip(at, full, strict=True)], pa.binary()),
                    pa.array([bands[k].view(np.int64) if f else None for k, f in zip(at, full, strict=True)], pa.list_(pa.int64()))],
                    names=["row", "r1", "r2", "n", "c", "regs", "bands"])
    return rows


def set_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", TEXT_CHUNK):
                flat, sizes = shingle_sets(Words(part.column("text"), lower=True), shingle)
                ends = np.cumsum(sizes)
                yield pa.record_batch([part.column("c"), pa.array([flat[e - s:e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())], names=["c", "set"])
    return rows


def likely(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity with the greatest joint likelihood of the numbers of larger, smaller and equal registers, given set sizes."""
    u = n / (n + m)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def value(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1))

    for _ in range(30):  # the likelihood has one peak
        third = (high - low) / 3
        up = value(low + third) < value(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def compared(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return likely((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), n.astype(float), m.astype(float))


def estimate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        if batch.num_rows:
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(compared(regs("regs_a"), regs("regs_b"), n, m))], names=["a", "b", "estimate"])


def verify_rows(threshold: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), threshold)
                    for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return rows


def shared_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which each pair agrees."""
    return (a == b).reshape(-1, BANDS, ROWS).all(2).argmax(1)


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of ``threshold``/100."""
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * both >= threshold * (len(x) + len(y) - both)


def block_links(threshold: int):
    """Links between components in one block of a bucket.

    ``shared`` counts the shingles of a set that any other set in question has too, so the lesser of two such counts bounds their
    intersection and rules out pairs before their registers are compared. A pair is looked at in its first common band only.
    What is left is compared whole, likeliest pairs first; a pair that links found here already join is left out.
    """

    def links(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group.i.iat[0], group.j.iat[0]
        own = group.own.to_numpy()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        regs = np.frombuffer(b"".join(group.regs), np.uint16).reshape(-1, REGISTERS)
        root, n, shared, number = pd.factorize(group.root)[0], group.n.to_numpy(), group.shared.to_numpy(), group.number.to_numpy()
        first, second = [], []
        for k, i in enumerate(left):
            others = right[k + 1:] if x == y else right
            both = np.minimum(shared[i], shared[others])
            others = others[(root[others] != root[i]) & (100 * both >= threshold * (n[i] + n[others] - both))]
            if len(others):
                others = others[(regs[others] == regs[i]).sum(1) >= REGISTERS * 0.5]
                first.append(np.full(len(others), i))
                second.append(others)
        if not first:
            return pd.DataFrame({"a": [], "b": []})
        a, b = np.concatenate(first), np.concatenate(second)
        keep = shared_band(regs[a], regs[b]) == number[a]
        a, b = a[keep], b[keep]
        guess = compared(regs[a], regs[b], n[a], n[b])
        order = np.argsort(-guess, kind="stable")[: int((guess >= ESTIMATE).sum())]
        sets, c, up = [np.frombuffer(s, np.uint64) for s in group["set"]], group.c.to_numpy(), list(range(root.max() + 1))

        def find(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        found = []
        for i, k in zip(a[order].tolist(), b[order].tolist(), strict=True):
            r, t = find(root[i]), find(root[k])
            if r != t and similar(sets[i], sets[k], threshold):
                up[r] = t
                found.append((c[i], c[k]))
        return pd.DataFrame(found, columns=["a", "b"])
    return links


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column("set").to_pylist()]
        if sets:
            rid = np.repeat(batch.column("rid").to_numpy(), [len(s) for s in sets])
            yield pa.record_batch([pa.array(rid), pa.array(np.concatenate(sets))], names=["rid", "h"])


def whole_sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(c, set, rid) of the classes in ``wanted`` (c): their whole shingle sets, from one text of each; only those texts move."""
    wanted = scratch.save(classes.join(small(wanted), "c", "left_semi").select("c", "rep.r1", "rep.r2"), "wanted")
    texts = rows.select("text", "r1", "r2").join(small(wanted), ["r1", "r2"]).dropDuplicates(["c"]).select("c", "text")
    sets = texts.mapInArrow(set_rows(shingle), "c binary, set binary")
    return scratch.save(sets.withColumn("rid", F.monotonically_increasing_id()), "sets")  # numbers hold once written


def verified(pairs: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold."""
    both = pairs.join(sets.select(F.col("c").alias("b"), F.col("set").alias("set_b")), "b").join(
        sets.select(F.col("c").alias("a"), F.col("set").alias("set_a")), "a")
    return scratch.save(both.mapInArrow(verify_rows(threshold), "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    threshold: int = 80, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: row (the columns ``carry``, default all), r1 and r2 (see ``keyed``), id, n_shingles, component_id, first.

    Texts whose sets of ``shingle`` successive lower-cased words have a Jaccard similarity of at least ``threshold``/100 are
    linked; component_id is the least id that links reach. A text with fewer words has its whole sequence as one shingle; null, empty
    and blank texts have none, stay alone and get their own id. Equal sets form one class before any comparison, so
    copies cost nothing. Null ids lose against others (component_id is null where all are); repeated rows get the same values;
    first holds for the rows of one r1 and r2 of each component, those with the least id (ties: the least r1 and r2);
    other columns are carried along; an empty table gives an empty result.

    Classes that share a band are compared in two steps, neither of which pairs up a whole bucket: first each class with its
    likeliest bucket leader; then, in buckets that still hold several components, members of different components only, in
    blocks of bounded size, and only pairs that the shingles they could share at all allow. Both are estimated from registers
    and then verified on whole sets.
    """
    scratch = scratch.fresh()
    rows = keyed(docs, text_col, [id_col], carry and list(dict.fromkeys([id_col, *carry])))
    kinds = "r1 long, r2 long, n long, c binary, regs binary, bands array<long>"
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(kinds).fields])
    sketches = scratch.save(rows.mapInArrow(sketch_rows(shingle), schema), "sketches")
    ids = F.col("row")[id_col]
    classes = scratch.save(sketches.where("c IS NOT NULL").groupBy("c").agg(
        F.min(F.struct(ids.isNull().alias("none"), ids.alias("id"), "r1", "r2")).alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"),
        F.first("bands").alias("bands")), "classes")
    banded = classes.select("c", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("c").alias("a"), F.count("*").alias("members")).where("members > 1")
    leaders = scratch.save(leaders, "leaders")
    inside = banded.join(small(leaders), "band")
    pairs = inside.where("a <> c").select("a", F.col("c").alias("b")).distinct()
    sides = classes.select("c", "n", "regs")
    near = pairs.join(sides.toDF("a", "n_a", "regs_a"), "a").join(sides.toDF("b", "n_b", "regs_b"), "b")
    near = near.where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    guessed = near.mapInArrow(estimate_rows, "a binary, b binary, estimate double").where(F.col("estimate") >= ESTIMATE)
    best = guessed.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b")
    best = scratch.save(best, "pairs")
    ends = best.select(F.col("a").alias("c")).union(best.select("b")).distinct()
    links = verified(best, whole_sets(ends, classes, rows, shingle, scratch), threshold, scratch)
    scratch.drop("pairs", "wanted", "sets")
    roots = components(links, scratch).toDF("c", "root")
    placed = inside.select("band", "c").join(small(roots), "c", "left").select("band", "c", F.coalesce("root", "c").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = scratch.save(placed.join(small(scratch.save(mixed.select("band"), "mixed")), "band"), "open")
    sets = whole_sets(open_.select("c").distinct(), classes, rows, shingle, scratch)
    alone = sets.select("rid", "set").mapInArrow(shingle_rows, "rid long, h long").groupBy("h").agg(F.count("*").alias("k"), F.min("rid").alias("rid"))
    alone = scratch.save(alone.where("k = 1").groupBy("rid").agg(F.count("*").alias("alone")), "alone")
    counted = sets.select("c", "rid", "set").join(small(alone), "rid", "left").select("c", "set", F.coalesce("alone", F.lit(0)).alias("alone"))
    members = scratch.save(counted.join(classes, "c").withColumn("shared", F.col("n") - F.col("alone")).where(
        f"100 * shared >= {threshold} * n").select("c", "n", "shared", "regs", "bands", "set"), "members")
    sizes = open_.join(members.select("c", "n"), "c").groupBy("band").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "blocks")
    cells = open_.join(small(scratch.save(sizes, "sizes")), "band").join(members, "c").select(
        "band", "c", "root", "n", "shared", "regs", "set", "blocks", (F.array_position("bands", F.col("band")) - 1).alias("number"),
        F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("own"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "number", "c", "root", "n", "shared", "regs", "set")
    more = scratch.save(cells.groupBy("band", "i", "j").applyInPandas(block_links(threshold), "a binary, b binary"), "links")
    roots = components(links.union(more), scratch).toDF("c", "root")
    named = classes.select("c", "rep").join(small(roots), "c", "left").select("c", "rep", F.coalesce("root", "c").alias("root"))
    least = scratch.save(named.groupBy("root").agg(F.min("rep").alias("least")), "least")
    named = scratch.save(named.join(least, "root").select("c", "least"), "named")
    scratch.keep("sketches", "named")
    out = sketches.select("row", "r1", "r2", "n", "c").join(named, "c", "left")
    return out.select("row", "r1", "r2", ids.alias("id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("c").isNull(), ids).otherwise(F.col("least.id")).alias("component_id"),
                      (F.col("c").isNull() | ((F.col("r1") == F.col("least.r1")) & (F.col("r2") == F.col("least.r2")))).alias("first"))
