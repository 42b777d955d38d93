"""Centroid clustering (Lloyd's rounds) over blocks of vectors in the order of a Hilbert curve, each block with a zone map.

A block holds vectors that lie next to each other on the curve, the box around them, and their sums. Distances between the box and the
centroids bound those of all its vectors: a centroid whose least distance exceeds another one's greatest cannot be nearest in the
block. A block with one candidate left is settled by its sums; otherwise its vectors are compared with the candidates only, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, bounded_batches

#: Components of a vector, parts of one unit, centroids, rounds; prefix of the numbers whose hashes choose the first centroids.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS, PREFIX = 64, 1024, 8, 10, "3:"
#: Vectors of a block, blocks that one task writes, bits of each component that the curve looks at.
BLOCK, BLOCKS_A_TASK, BITS = 512, 16, 4
#: Components from here on have squared distances that do not fit 64 bits.
LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve, as byte strings in its order, of points with whole coordinates below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations of the sub-cubes, from the largest one on
        low = level - 1
        for i in range(n):
            inverted = (x[i] & level) > 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[n - 1] & level) > 0, level - 1, 0)
        level >>= 1
    x ^= turn
    planes = np.stack([(x >> b & 1).T for b in range(bits - 1, -1, -1)], 1)  # the highest bits of all coordinates first
    return [row.tobytes() for row in np.packbits(planes.reshape(len(cells), -1).astype(np.uint8), axis=1)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def key_rows(low: list[int], high: list[int], bits: int):
    """Each vector with its place on the curve, over the box (low, high) of all vectors, and a number that tells equal rows of a task apart."""
    base, span = np.array(low, float), np.maximum(np.array(high, float) - np.array(low, float), 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if len(batch):
                n += len(batch)
                cells = np.minimum((matrix(batch.column("v"), len(base)) - base) / span * (1 << bits), (1 << bits) - 1).astype(np.int64)
                number = pa.array(np.arange(n - len(batch), n))
                yield pa.record_batch([*batch.columns, pa.array(hilbert_keys(cells, bits), pa.binary()), number], names=[*batch.schema.names, "place", "n"])
    return rows


def pack(v: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each."""
    for kind in (np.int16, np.int32):
        if not len(v) or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind).tobytes()
    return v.tobytes()


def unpack(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // max(1, rows * width)]).reshape(rows, width).astype(np.int64)


def block_rows(size: int, width: int):
    """Blocks of successive vectors: their ids, the vectors, the box around them (low, high) and their sums."""

    def made(ids: list, v: np.ndarray) -> pa.RecordBatch:
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (v.min(0), v.max(0), v.sum(0))]
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([pack(v)], pa.binary()), *lists], names=["ids", "vectors", "low", "high", "sums"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = [], np.empty((0, width), np.int64)
        for batch in batches:
            if len(batch):
                ids, v = ids + batch.column("id").to_pylist(), np.concatenate([v, matrix(batch.column("v"), width)])
            while len(ids) >= size:
                yield made(ids[:size], v[:size])
                ids, v = ids[size:], v[size:]
        if ids:
            yield made(ids, v)
    return rows


BLOCKS = "ids array<long>, vectors binary, low array<long>, high array<long>, sums array<long>"


def box_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box. Ties stay: the smaller number wins among vectors."""
    apart = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    across = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((apart**2).sum(1) <= (across**2).sum(1).min())


def nearest(v: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, of those in ``among`` (ascending; ties: the first), and the squared distance."""
    best, least = np.full(len(v), among[0]), ((v - centroids[among[0]]) ** 2).sum(1)
    for c in among[1:]:
        d = ((v - centroids[c]) ** 2).sum(1)
        closer = d < least
        best[closer], least[closer] = c, d[closer]
    return best, least


def blocks_of(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for block in batch.to_pylist():
            yield block, box_candidates(np.array(block["low"]), np.array(block["high"]), centroids)


def sum_rows(centroids: np.ndarray):
    """Per task and centroid: how many vectors are nearest to it, and their sums."""
    k, width = centroids.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for block, among in blocks_of(batches, centroids):
            n = len(block["ids"])
            if len(among) == 1:
                count[among[0]] += n
                sums[among[0]] += block["sums"]
                continue
            v = unpack(block["vectors"], n, width)
            best, _ = nearest(v, centroids, among)
            count += np.bincount(best, minlength=k)
            np.add.at(sums, best, v)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
    return rows


def assigned_rows(centroids: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, among in blocks_of(batches, centroids):
            best, least = nearest(unpack(block["vectors"], len(block["ids"]), centroids.shape[1]), centroids, among)
            yield pa.record_batch([pa.array(block["ids"], pa.int64()), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])
    return rows


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v: vectors of DIMENSIONS finite components, each as floor(SCALE * x), if all are below LARGEST in size."""
    scaled = lambda x: x.cast("double") * SCALE
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < LARGEST))
    rows = table.where((F.size(vector_col) == DIMENSIONS) & fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(scaled(x))).alias("v"))


def clustered(table: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CENTROIDS, rounds: int = ROUNDS,
              block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance (squared) of every kept vector, and the final centroids.

    A vector counts if it has exactly DIMENSIONS components, none null or non-finite; a component becomes floor(SCALE * x), and vectors with
    one of LARGEST or more in size are left out, as their distances do not fit. The vectors with the smallest hashes of their
    ids begin as centroids; those without an id take part but do not begin; repeated rows are vectors each (ties: by components);
    with fewer vectors than ``clusters`` there are fewer centroids, and none without any. Other columns are ignored.
    Blocks are written once to the shared folder; a round reads them, and its sums are added up in tasks, then by Spark.
    """
    bounded_batches(table.sparkSession)
    vectors = scratch.save(whole_vectors(table, id_col, vector_col), "vectors")
    first = vectors.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(PREFIX), F.col("id").cast("string")), 256).alias("h"), "v")
    centroids = np.array([r.v for r in first.orderBy("h", "v").limit(clusters).collect()], np.int64).reshape(-1, DIMENSIONS)
    if not len(centroids):
        return vectors.limit(0).select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    total, *box = vectors.select(F.count("*"), *(f(F.get("v", F.lit(i))) for f in (F.min, F.max) for i in range(DIMENSIONS))).first()
    placed = vectors.mapInArrow(key_rows(box[:DIMENSIONS], box[DIMENSIONS:], BITS), "id long, v array<long>, place binary, n long")
    order = ["place", "id", "n"]
    placed = scratch.save(placed, "placed").repartitionByRange(-(-total // (BLOCKS_A_TASK * block)), *order).sortWithinPartitions(*order)
    blocks = scratch.save(placed.select("id", "v").mapInArrow(block_rows(block, DIMENSIONS), BLOCKS), "blocks")
    scratch.keep("blocks")
    for _ in range(rounds):
        partial = blocks.mapInArrow(sum_rows(centroids), "cluster int, n long, sums array<long>")
        each = partial.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        centroids = centroids.copy()
        for r in each.collect():  # clusters x components
            centroids[r.cluster, r.i] = r.x // r.n
    return blocks.mapInArrow(assigned_rows(centroids), "vec_id long, cluster int, distance long"), centroids.tolist()


def with_inertia(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``found`` with its distances summed up by cluster (cluster_inertia) and over all (inertia)."""
    found = scratch.save(found, "assigned")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per centroid
    total = sum(r.cluster_inertia for r in each)
    own = F.lit(None).cast("long")
    for r in each:
        own = F.when(F.col("cluster") == r.cluster, F.lit(r.cluster_inertia)).otherwise(own)
    return found.select("*", own.cast("long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"))
