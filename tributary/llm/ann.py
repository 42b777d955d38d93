"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0); the nearest by distance is then the one with
the largest inner product, so a Euclidean tree serves it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.local import local_table
from tributary.llm.common import SEED, Scratch, small

#: The tree is fitted on at most this many vectors; every vector is indexed.
SAMPLE = 40_000
#: Children of a node, rounds of k-means, vectors of the whole table per leaf, sampled vectors a leaf needs.
BRANCH, ROUNDS, LEAF_ROWS, LEAF_SAMPLE = 8, 8, 400, 16
#: Queries that calibrate the number of leaves, and the mean recall they must reach.
CALIBRATION, RECALL = 150, 0.94
#: Vectors and queries of one block; queries that are multiplied at once.
BLOCK, QUERIES = 8_192, 256


@dataclass
class Tree:
    """Nodes in order of creation: centres, children (none: a leaf) and, for leaves, a leaf number."""

    norm: float
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def grow(self, x: np.ndarray, most: int, random: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(x.mean(0) if len(x) else np.zeros(x.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        groups = kmeans(x, BRANCH, random) if len(x) > most else None
        if groups is None:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        else:
            self.children[node] = [self.grow(x[groups == g], most, random) for g in np.unique(groups)]
        return node

    def distances(self, x: np.ndarray, nodes: list[int]) -> np.ndarray:
        """Squared distances to nodes' centres, less what is the same for all nodes."""
        c = np.stack([self.centres[n] for n in nodes])
        return (c * c).sum(1) - 2 * x @ c.T

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each (lifted) vector: the nearest child at every level."""
        out, todo = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = self.distances(x[rows], self.children[node]).argmin(1)
                todo += [(child, rows[nearest == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query the first ``most`` leaves, best bin first: a queue holds branches not yet taken by their distance."""
        far = self.distances(np.concatenate([q, np.zeros((len(q), 1))], 1), list(range(len(self.centres)))) if len(q) else []
        out = []
        for d in far:
            queue, leaves = [(0.0, 0)], []
            while queue and len(leaves) < most:
                node = heapq.heappop(queue)[1]
                while self.leaf[node] < 0:
                    first, *rest = sorted((float(d[c]), c) for c in self.children[node])
                    for branch in rest:
                        heapq.heappush(queue, branch)
                    node = first[1]
                leaves.append(self.leaf[node])
            out.append(leaves)
        return out


def kmeans(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray | None:
    """Groups of vectors; none if all are the same."""
    centres = x[random.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        used = np.unique(own)
        centres = np.stack([x[own == g].mean(0) for g in used])
    own = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
    return own if len(np.unique(own)) > 1 else None


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the ``k`` best vectors of a block other than itself: query ids, vector ids, scores. A matrix product finds them, with
    all that are as good as the last one up to rounding; sums of the same order for all score them, ties go to smaller ids.
    ``seen`` says which vectors each query looks at (default: all)."""
    if len(q) > QUERIES:
        cuts = range(0, len(q), QUERIES)
        found = [best(ids, x, queries[i:i + QUERIES], q[i:i + QUERIES], k, None if seen is None else seen[i:i + QUERIES]) for i in cuts]
        return tuple(np.concatenate(o) for o in zip(*found, strict=True))
    rough = q @ x.T
    if seen is not None:
        rough[~seen] = -np.inf
    rough[queries[:, None] == ids[None, :]] = -np.inf
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        r = rough[i]
        last = np.partition(r, len(r) - k)[len(r) - k] if len(r) > k else -np.inf
        which = np.flatnonzero((r >= last - 1e-9 * (abs(last) + 1)) & (r > -np.inf)) if last > -np.inf else np.flatnonzero(r > -np.inf)
        score = (x[which] * q[i]).sum(1)
        order = np.lexsort((ids[which], -score))[:k]
        out_q.append(np.full(len(order), queries[i]))
        out_v.append(ids[which][order])
        out_s.append(score[order])
    return tuple(np.concatenate(o) if o else np.empty(0) for o in (out_q, out_v, out_s))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, by score and then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit(vectors: DataFrame, norm: float, rows: int) -> Tree:
    """A tree over a sample of at most SAMPLE vectors, the ones with the smallest hashes."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    tree = Tree(norm)
    x = tree.lifted(matrix(sample["vec"].combine_chunks())) if len(sample) else np.zeros((0, 1))
    most = max(LEAF_SAMPLE, LEAF_ROWS * len(x) // max(rows, 1))
    tree.grow(x, most, np.random.Generator(np.random.PCG64(SEED)))
    return tree


def placed_rows(tree: Tree):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"))
            leaf = tree.place(tree.lifted(x)) if len(x) else np.empty(0, np.int32)
            yield pa.record_batch([batch.column("vec_id"), batch.column("vec"), pa.array(leaf, pa.int32())], names=["vec_id", "vec", "leaf"])
    return rows


def visit_rows(tree: Tree, most: int, cells: np.ndarray):
    """A row per query and cell with the leaves that the query visits there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell, leaves = [], [], []
            for i, visited in enumerate(tree.visits(matrix(batch.column("vec")), most)):
                own = np.sort(visited)
                names, start = np.unique(cells[own], return_index=True)
                at += [i] * len(names)
                cell += names.tolist()
                leaves += [x.tolist() for x in np.split(own, start[1:])]
            at = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column("vec_id").take(at), batch.column("vec").take(at), pa.array(cell, pa.int32()),
                                   pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "cell", "leaves"])
    return rows


def brute_rows(ids: np.ndarray, q: np.ndarray, k: int):
    """The best vectors of each task for a few queries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = dict(zip(batch.column("vec_id").to_pylist(), batch.column("leaf").to_pylist(), strict=True))
                a, b, s = best(batch.column("vec_id").to_numpy(), matrix(batch.column("vec")), ids, q, k)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()),
                                       pa.array([leaf[v] for v in b.tolist()], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])
    return rows


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaf visits with which the calibration queries reach the recall, against all vectors."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "vec").toArrow()
    if not len(sample):
        return 1
    ids, q = sample["vec_id"].to_numpy(), matrix(sample["vec"].combine_chunks())
    found = index.mapInArrow(brute_rows(ids, q, k), "query_id long, vec_id long, score double, leaf int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "leaf").collect()
    place = {i: {leaf: n for n, leaf in enumerate(v)} for i, v in zip(ids.tolist(), tree.visits(q, tree.leaves), strict=True)}
    need = sorted(place[r.query_id][r.leaf] for r in truth)
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] + 1 if need else 1


def block_rows(k: int):
    def rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        leaves, own = np.unique(left.leaf, return_inverse=True)
        visited = np.stack([np.isin(leaves, v) for v in right.leaves])
        a, b, s = best(left.vec_id.to_numpy(), np.stack(left.vec).astype(float), right.query_id.to_numpy(), np.stack(right.q).astype(float), k, visited[:, own])
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})
    return rows


def nearest(table: DataFrame, scratch: Scratch, queries, k: int = 20, recall: float = RECALL, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row that the condition ``queries`` (over vec_id) takes, the ``k`` vectors
    with the largest inner product among all other rows.

    Vectors that are null or zero, hold null or non-finite components, lack an id, or have another length than most take no
    part; fewer than ``k`` candidates are all returned; ties go to smaller ids; of repeated query rows one counts, repeated
    vectors are candidates each; other columns are ignored; an empty table gives an empty result.

    Leaves hold a fixed number of vectors and queries visit a calibrated number of them. Neighbouring leaves share a cell of about
    BLOCK vectors, and a cell is searched in blocks of BLOCK vectors times BLOCK queries, so neither a large leaf nor a popular
    one lands in one task, and a query has ``k`` rows per block. Where vectors have no clusters, calibration asks for many leaves.
    """
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    vectors = table.where(v.isNotNull() & F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    size = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    vectors = vectors.where(F.size("vec") == (size.d if size else 0))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, most = vectors.agg(F.count("*"), F.max(norm)).first()
    tree = fit(vectors, most or 0.0, total)
    index = scratch.save(vectors.mapInArrow(placed_rows(tree), T.StructType([*vectors.schema.fields, T.StructField("leaf", T.IntegerType())])), "index")
    asked = index.where(queries).dropDuplicates(["vec_id"]).select("vec_id", "vec")
    visits = calibrated(index, asked, tree, k, recall)
    kind = vectors.schema["vec"].dataType.simpleString()
    counts = np.zeros(tree.leaves, np.int64)  # one number per leaf of the tree
    for r in index.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    cells = ((np.cumsum(counts) - counts) // BLOCK).astype(np.int32)
    visited = asked.mapInArrow(visit_rows(tree, visits, cells), f"query_id long, q {kind}, cell int, leaves array<int>")
    visited = scratch.save(visited, "visits")
    index = index.join(F.broadcast(local_table(table.sparkSession, [(i, int(c)) for i, c in enumerate(cells)], "leaf int, cell int")), "leaf")
    blocks = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / BLOCK).cast("int")
    sizes = index.groupBy("cell").agg(blocks(F.count("*")).alias("parts"))
    sizes = small(scratch.save(sizes.join(visited.groupBy("cell").agg(blocks(F.count("*")).alias("sets")), "cell"), "sizes"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rows = index.join(sizes, "cell").select("cell", "leaf", "vec_id", "vec", own("vec_id", "parts").alias("part"), spread("sets").alias("set"))
    asks = visited.join(sizes, "cell").select("cell", "query_id", "q", "leaves", own("query_id", "sets").alias("set"), spread("parts").alias("part"))
    keys = ["cell", "part", "set"]
    found = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(block_rows(k), "query_id long, vec_id long, score double")
    return ranked(found, k)
