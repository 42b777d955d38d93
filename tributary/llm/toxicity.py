"""Toxicity categories by a classifier chain: each linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import Scratch, chunks, small, text_rows

#: Labelled documents that the models are fitted on, by their whole texts. Scoring sees whole texts of all rows.
SAMPLE = 6_000
#: Word and affix features: of those in at least FREQUENT documents the most telling ones of each category, with a chi-square of at least
#: TELLING (one in a thousand by chance). Folds of the chain.
FEATURES, FREQUENT, TELLING, FOLDS = 600, 3, 10.83, 3
#: Rounds, step and weight decay of the fit. Distinct tokens that a worker remembers. Probability from which a category holds.
ROUNDS, RATE, DECAY, REMEMBERED, THRESHOLD = 200, 0.5, 1e-4, 100_000, 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the affixes of a word that are features beside it.
AFFIXES = range(3, 7)


def features(word: str) -> list[str]:
    """The word, and its prefixes and suffixes with a mark for what is left out."""
    cut = [n for n in AFFIXES if n < len(word)]
    return [word, *(word[:n] + "-" for n in cut), *("-" + word[-n:] for n in cut)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Documents as lists of feature numbers, end to end."""

    flat: np.ndarray
    doc: np.ndarray
    size: int

    def take(self, keep: np.ndarray) -> Rows:
        number = np.cumsum(keep) - 1
        inside = keep[self.doc]
        return Rows(self.flat[inside], number[self.doc[inside]], int(keep.sum()))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights[self.flat], minlength=self.size) if len(self.flat) else np.zeros(self.size)


def logistic(rows: Rows, dense: np.ndarray, y: np.ndarray, features: int) -> np.ndarray:
    """Weights of word features, then of dense columns, then the constant: logistic regression by adaptive gradient steps."""
    w, grown = np.zeros(features + dense.shape[1] + 1), np.full(features + dense.shape[1] + 1, 1e-8)
    if not len(y) or y.min() == y.max():  # one class only: its smoothed rate
        rate = (y.sum() + 0.5) / (len(y) + 2)
        w[-1] = np.log(rate / (1 - rate))
        return w
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(ROUNDS):
        error = y - predicted(w, rows, dense, features)
        gradient = np.concatenate([np.bincount(rows.flat, error[rows.doc], minlength=features), dense.T @ error, [error.sum()]]) / len(y)
        gradient[:-1] -= DECAY * w[:-1]
        grown += gradient**2
        w += RATE * gradient / np.sqrt(grown)
    return w


def predicted(w: np.ndarray, rows: Rows, dense: np.ndarray, features: int) -> np.ndarray:
    return sigmoid(rows.times(w[:features]) + dense @ w[features:-1] + w[-1])


class Presence:
    """Which of the chosen features texts have."""

    def __init__(self, words: list[str]):
        self.words, self.place = {w: i for i, w in enumerate(words)}, {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "place": {}}

    def lists(self, texts: list[str]) -> list[list[int]]:
        """Feature numbers per text, each once; a token may hold several words."""
        tokens = [set(t.lower().split()) for t in texts]
        if len(self.place) > REMEMBERED:
            self.place = {}
        for t in set().union(*tokens) - self.place.keys():
            own = chain.from_iterable(map(features, [t] if t.isalpha() else WORD.findall(t)))
            self.place[t] = tuple(self.words[w] for w in own if w in self.words)
        return [sorted(set(chain.from_iterable(map(self.place.__getitem__, ts)))) for ts in tokens]


def as_rows(lists: list[list[int]]) -> Rows:
    sizes = [len(f) for f in lists]
    return Rows(np.fromiter(chain.from_iterable(lists), np.int64, sum(sizes)), np.repeat(np.arange(len(lists)), sizes), len(lists))


@dataclass
class Chain:
    """Features and the models of the categories, in order."""

    categories: list[str]
    presence: Presence
    models: list[np.ndarray]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        rows, p = as_rows(self.presence.lists(texts)), np.zeros((len(texts), 0))
        for w in self.models:
            p = np.concatenate([p, predicted(w, rows, p, len(self.presence.words))[:, None]], 1)
        return p


def fitted(rows: Rows, fold: np.ndarray, labels: np.ndarray, n: int) -> list[np.ndarray]:
    """Models of a chain over ``n`` features: later ones learn from out-of-fold probabilities of the earlier categories."""
    models, p = [], np.zeros((rows.size, 0))
    for k in range(labels.shape[1]):
        y, held = labels[:, k].astype(float), np.zeros(rows.size)
        models.append(logistic(rows, p, y, n))
        for f in range(FOLDS if k + 1 < labels.shape[1] else 0):
            w = logistic(rows.take(fold != f), p[fold != f], y[fold != f], n)
            held[fold == f] = predicted(w, rows.take(fold == f), p[fold == f], n)
        p = np.concatenate([p, held[:, None]], 1)
    return models


def counted_rows(k: int):
    """Per chunk of texts and feature: texts that have it, and those of each category."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                docs = [set(chain.from_iterable(map(features, set(WORD.findall(t.lower()))))) for t in part.column("text").to_pylist()]
                y = part.column("y").to_pylist()
                seen = Counter(chain.from_iterable(docs))
                hits = [Counter(chain.from_iterable(d for d, one in zip(docs, y, strict=True) if one[c])) for c in range(k)]
                words = list(seen)
                yield pa.record_batch([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()),
                                       pa.array([[h[w] for h in hits] for w in words], pa.list_(pa.int64()))], names=["word", "n", "hits"])
    return rows


def telling(sample: DataFrame, k: int, rows: int, positive: list[int]) -> list[str]:
    """For each of ``k`` categories the features whose presence differs most between its documents and the others (chi-square; ties: the
    least), of those in FREQUENT documents or more. Counted by Spark; FEATURES strings per category reach the driver."""
    counts = sample.mapInArrow(counted_rows(k), "word string, n long, hits array<long>").groupBy("word").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("hits", F.lit(c))).alias(f"h{c}") for c in range(k)]).where(F.col("n") >= FREQUENT)
    chosen: set[str] = set()
    for c in range(k):
        rate = positive[c] / rows if rows else 0.0
        score = (F.col(f"h{c}") - F.col("n") * rate) ** 2 / F.greatest(F.col("n") * rate * (1 - rate), F.lit(1e-9))
        best = counts.select("word", score.alias("score")).where(F.col("score") >= TELLING).orderBy(F.desc("score"), "word").limit(FEATURES)
        chosen.update(r.word for r in best.select("word").collect())
    return sorted(chosen)


def feature_rows(presence: Presence):
    """Feature numbers and the fold of every text; copies share a fold."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                yield pa.record_batch([part.column("h"), part.column("y"), pa.array(presence.lists(texts), pa.list_(pa.int32())),
                                       pa.array([zlib.crc32(t.encode()) % FOLDS for t in texts], pa.int32())], names=["h", "y", "found", "fold"])
    return rows


def sampled(docs: DataFrame, labels: DataFrame, categories: dict, id_col: str, text_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents: the number h, text, and y, the labels in the order of the categories."""
    marks = labels.select(F.col(id_col).alias("__id"), F.array(*categories.values()).alias("y")).where(
        F.col("__id").isNotNull() & F.forall("y", lambda c: c.isNotNull())).distinct()
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # Ids meet first, so labels of absent documents take no place; only the texts of the sample move.
    picked = marks.join(known.select("__id"), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id", "y").limit(rows)
    found = known.join(small(picked), "__id").select(F.xxhash64("__id", "text", "y").alias("h"), "text", "y").distinct()
    return found.join(small(found.select("h").distinct().orderBy("h").limit(rows)), "h", "left_semi")  # ids may have several texts


def fit(docs: DataFrame, labels: DataFrame, categories: dict, id_col: str, text_col: str, scratch: Scratch, rows: int = SAMPLE) -> Chain:
    """The chain. The driver holds feature numbers, folds and labels of the sample, no texts."""
    k = len(categories)
    sample = scratch.save(sampled(docs, labels, categories, id_col, text_col, rows).repartition(8, "h"), "sample")
    size, *positive = sample.select(F.count("*"), *[F.coalesce(F.sum(F.get("y", F.lit(c)).cast("int")), F.lit(0)) for c in range(k)]).first()
    presence = Presence(telling(sample, k, size, positive))
    found = sample.mapInArrow(feature_rows(presence), "h long, y array<boolean>, found array<int>, fold int").toArrow()
    found = found.combine_chunks().sort_by([("h", "ascending"), ("fold", "ascending")]).to_pydict() if size else {c: [] for c in ("y", "found", "fold")}
    scratch.drop("sample")
    models = fitted(as_rows(found["found"]), np.array(found["fold"], np.int64), np.array(found["y"], bool).reshape(-1, k), len(presence.words))
    return Chain(list(categories), presence, models)


def chain_rows(model: Chain, text_col: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", inside=text_col):
                p = model.probabilities(part.column("text").to_pylist())
                yield pa.record_batch([part.column("row"), *(pa.array(c) for c in p.T)], names=["row", *(f"p_{c}" for c in model.categories)])
    return rows


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
             sample: int = SAMPLE) -> DataFrame:
    """row (the columns ``carry``, default all) and, per category, p_<category> and the boolean <category>.

    ``categories`` maps each name, in the order of the chain, to a condition over ``labels``. Models are fitted on at most ``sample``
    labelled documents with a text, the ones with the smallest hashes of their ids; every document is scored by its whole text.
    Null and empty texts have no words and get the models' base rates; rows with a null label, or of documents that are not
    there, do not train; a document with two different labels trains once with each; with no labels every probability is a quarter
    and no category holds; null ids, repeated rows and other columns of any name are carried along; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit(docs, labels, categories, id_col, text_col, scratch, sample)
    rows = text_rows(docs, text_col, carry)
    scored = rows.mapInArrow(chain_rows(model, text_col), T.StructType([rows.schema["row"], *(T.StructField(f"p_{n}", T.DoubleType()) for n in categories)]))
    return scored.select("*", *((F.col(f"p_{n}") >= THRESHOLD).alias(n) for n in categories))
