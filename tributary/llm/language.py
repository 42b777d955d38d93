"""Languages of words in code-switched text by a linear-chain conditional random field, and of documents from them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import SEED, bounded_batches, chunks, mix, text_rows

#: Training texts per language, the characters that one has at most, and from how many places of a longer text they come. Everything
#: else sees whole texts of all rows.
PER_LANGUAGE, LONGEST, PLACES = 200, 20_000, 20
#: Training sequences, their length, mean words between switches; rounds and step of the fit, weight decay.
SEQUENCES, STEPS, SPAN, ROUNDS, RATE, DECAY = 1_500, 64, 20, 30, 0.5, 1e-4
#: Hash buckets of affixes and n-grams (of up to GRAM bytes), and how often a word must occur to enter the lexicon.
BUCKETS, GRAM, LEXICON = 1 << 16, 4, 2
#: Distinct words that a worker remembers.
REMEMBERED = 100_000
UNKNOWN = "und"


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and how many each word has: n-grams of ``^word$`` bytes, of which those with an end are the
    affixes, and the word's place in the lexicon."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    size = np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    owner, codes, code = [], [], np.zeros(len(data), np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    for n in range(1, GRAM + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: len(data) - n + 1] = data[n - 1:]
        code = code * np.uint64(257) + shifted + np.uint64(1)
        fits = left >= n
        codes.append(mix(code[fits] + np.uint64(n << 40)) % np.uint64(BUCKETS))
        owner.append(word[fits])
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    codes.append((known[known >= 0] + BUCKETS).astype(np.uint64))
    owner.append(np.flatnonzero(known >= 0))
    codes, owner = np.concatenate(codes).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return codes[order], np.bincount(owner, minlength=len(words))


def summed(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of successive rows, ``counts[i]`` of them each (one at least)."""
    return np.add.reduceat(rows, np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, rows.shape[1]), rows.dtype)


@dataclass
class Crf:
    """Weights of features by language, transition weights, and the lexicon."""

    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    place: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def scores(self, words: list[str]) -> np.ndarray:
        codes, counts = features(words, self.lexicon)
        return summed(self.weights[codes] / np.sqrt(np.repeat(counts, counts))[:, None].astype(np.float32), counts)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """For the words with letters of all texts their row in ``table``, how many each text has, and all words."""
        words = [t.lower().split() for t in texts]
        if len(self.place) > REMEMBERED or self.table is None:
            self.place, self.table = {}, np.zeros((0, len(self.languages)), np.float32)
        new = sorted(set().union(*words) - self.place.keys())
        spelt = [letters(w) for w in new]
        named = [(w, s) for w, s in zip(new, spelt, strict=True) if s]
        self.place |= dict.fromkeys((w for w, s in zip(new, spelt, strict=True) if not s), -1)
        self.place |= {w: len(self.table) + i for i, (w, _) in enumerate(named)}
        if named:
            self.table = np.concatenate([self.table, self.scores([s for _, s in named])])
        flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64)
        text = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        return flat[flat >= 0], np.bincount(text[flat >= 0], minlength=len(texts)), words

    def marginals(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Forward-backward over all texts at once, one step per word position: the probability of each language of each word."""
        if not len(rows) or not self.languages:
            return np.zeros((0, len(self.languages)), np.float32)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        text = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = np.cumsum(np.bincount(step))
        where = np.concatenate([[0], ends[:-1]])[step] + rank[text]
        e = np.empty((len(rows), len(self.languages)), np.float32)
        e[where] = self.table[rows]
        return forward_backward(e, ends, self.moves)[where]


def forward_backward(e: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of sequences stored step by step, longest first: step t holds rows ends[t-1]:ends[t]."""
    np.exp(e - e.max(1, keepdims=True), out=e)
    move = np.exp(moves - moves.max()).astype(np.float32)
    back = move.T.copy()
    cuts = [0, *ends.tolist()]
    ahead, after = np.empty_like(e), np.ones_like(e)
    before = None
    for s, t in zip(cuts[:-1], cuts[1:], strict=True):
        now = e[s:t] if before is None else (before[: t - s] @ move) * e[s:t]
        before = ahead[s:t]
        np.divide(now, now.sum(1, keepdims=True), out=before)
    for i in range(len(cuts) - 2, 0, -1):
        s, t = cuts[i], cuts[i + 1]
        now = (after[s:t] * e[s:t]) @ back
        after[cuts[i - 1]:cuts[i - 1] + t - s] = now / now.sum(1, keepdims=True)
    ahead *= after
    ahead /= ahead.sum(1, keepdims=True)
    return ahead


def fit(texts: list[tuple[str, str]]) -> Crf:
    """A field trained on sequences that switch between documents of different languages, by the gradient of their likelihood."""
    random = np.random.Generator(np.random.PCG64(SEED))
    languages = sorted({lang for _, lang in texts})
    docs: list[list[list[str]]] = [[] for _ in languages]
    for text, lang in texts:
        if words := [w for w in map(letters, text.lower().split()) if w]:
            docs[languages.index(lang)].append(words)
    have = [i for i, d in enumerate(docs) if d]
    n = len(languages)
    if not have:
        return Crf([], {}, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    words, labels = [], []
    for _ in range(SEQUENCES):
        seq: list[str] = []
        own: list[int] = []
        while len(seq) < STEPS:
            lang = have[random.integers(len(have))]
            doc = docs[lang][random.integers(len(docs[lang]))]
            at, length = random.integers(len(doc)), 1 + random.geometric(1 / SPAN)
            seq += doc[at:at + length]
            own += [lang] * len(doc[at:at + length])
        words.append(seq[:STEPS])
        labels.append(own[:STEPS])
    counts = Counter(chain.from_iterable(words))
    lexicon = {w: i for i, w in enumerate(sorted(w for w, c in counts.items() if c >= LEXICON))}
    types = sorted(counts)
    number = {w: i for i, w in enumerate(types)}
    codes, sizes = features(types, lexicon)
    share = (1 / np.sqrt(np.repeat(sizes, sizes))).astype(np.float32)
    grid, y = np.array([[number[w] for w in s] for s in words]).T, np.array(labels).T
    crf = Crf(languages, lexicon, np.zeros((BUCKETS + len(lexicon), n), np.float32), np.zeros((n, n), np.float32))
    grown, grown_moves = np.full_like(crf.weights, 1e-6), np.full_like(crf.moves, 1e-6)
    ends = np.arange(1, STEPS + 1) * SEQUENCES
    truth = np.zeros((STEPS * SEQUENCES, n), np.float32)
    truth[np.arange(len(truth)), y.ravel()] = 1
    pairs = np.zeros((n, n))
    np.add.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
    for _ in range(ROUNDS):
        table = summed(crf.weights[codes] * share[:, None], sizes)
        e = table[grid.ravel()]
        p = forward_backward(e.copy(), ends, crf.moves)
        up = np.zeros((len(types), n), np.float32)
        np.add.at(up, grid.ravel(), truth - p)
        wide = np.repeat(up, sizes, axis=0) * share[:, None]
        gradient = np.stack([np.bincount(codes, wide[:, k], minlength=len(crf.weights)) for k in range(n)], 1) / SEQUENCES - DECAY * crf.weights
        grown += gradient**2
        crf.weights += (RATE * gradient / np.sqrt(grown)).astype(np.float32)
        p = p.reshape(STEPS, SEQUENCES, n)
        move = np.exp(crf.moves)
        joint = p[:-1, :, :, None] * move[None, None] * p[1:, :, None, :]
        expected = (joint / joint.sum((2, 3), keepdims=True)).sum((0, 1))
        step = (pairs - expected) / SEQUENCES - DECAY * crf.moves
        grown_moves += step**2
        crf.moves += (RATE * step / np.sqrt(grown_moves)).astype(np.float32)
    return crf


def excerpt(text):
    """A text of at most LONGEST characters as it is; of a longer one the whole words of PLACES pieces that lie evenly in it."""
    size = LONGEST // PLACES
    place = lambda i: F.substring(text, (1 + i * (F.length(text) - size) / (PLACES - 1)).cast("int"), F.lit(size))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.regexp_replace(place(i), r"^\S+\s|\s\S+$", ""))
    return F.when(F.length(text) <= LONGEST, text).otherwise(F.concat_ws(" ", pieces))


def training_texts(docs: DataFrame, usable, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """PER_LANGUAGE different labelled texts of each language, the ones with the smallest hashes; longer ones than LONGEST only where
    the others are too few, and of these an excerpt."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(text_col).alias("h"), (F.length(text_col) > LONGEST).alias("long"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    marks = rows.select("lang", "long", "h").distinct()
    counts = docs.sparkSession.createDataFrame(marks.groupBy("lang", "long").agg(F.count("*").alias("n")).collect(), "lang string, long boolean, n long")
    spread = F.pmod("h", F.lit(1_000_000)) * F.col("n") < 1_000_000 * 3 * PER_LANGUAGE
    order = Window.partitionBy("lang").orderBy("long", "h")
    few = marks.join(F.broadcast(counts), ["lang", "long"]).where(spread).withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_LANGUAGE)
    picked = docs.sparkSession.createDataFrame(few.select("lang", "long", "h", "r").collect(), "lang string, long boolean, h long, r int")
    found = rows.join(F.broadcast(picked), ["lang", "long", "h"]).groupBy("lang", "r").agg(F.min(excerpt(F.col("text"))).alias("text"))
    return [(r.text, r.lang) for r in found.orderBy("lang", "r").select("text", "lang").collect()]


def language_rows(crf: Crf, with_words: bool, text_col: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*crf.languages, UNKNOWN], object)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20, text_col):
                at, counts, words = crf.rows(part.column("text").to_pylist())
                p = crf.marginals(at, counts)
                total = np.zeros((len(part), max(1, p.shape[1])))
                full = (counts > 0) & bool(crf.languages)
                if full.any():
                    total[full] = summed(p.astype(np.float64), counts[full]) / counts[full, None]
                best = np.where(full, total.argmax(1), len(crf.languages)) if crf.languages else np.zeros(len(part), int)
                score = np.where(full, np.clip(total.max(1), 0, 1), 0.0)
                sure = np.zeros(len(part))
                if full.any():
                    even = 1 / len(crf.languages)
                    top = summed(p.max(1, keepdims=True).astype(np.float64), counts[full])[:, 0] / counts[full]
                    sure[full] = np.clip((top - even) / (1 - even), 0, 1) if len(crf.languages) > 1 else 1.0
                out = [part.column("row"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(sure)]
                if with_words:
                    tags = names[p.argmax(1)] if len(p) else np.full(int(counts.sum()), UNKNOWN, object)
                    ends = np.cumsum(counts)
                    spoken = [[w for w in ws if crf.place[w] >= 0] for ws in words]
                    out.append(pa.array([[{"word": w, "lang": g} for w, g in zip(ws, tags[e - c:e], strict=True)] for ws, e, c in zip(spoken, ends, counts, strict=True)],
                                        pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())]))))
                yield pa.record_batch(out, names=["row", "lang_pred", "score", "certainty", "words"][: len(out)])
    return rows


def identified(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               carry: list[str] | None = None, with_words: bool = False) -> DataFrame:
    """row (the columns ``carry``, default all), lang_pred, score, certainty and, if asked for, words with the language of each.

    The field learns from rows that the condition ``usable`` takes; predictions use the text alone. lang_pred is the language with
    the largest mean probability over the text's words, score that mean. certainty is the mean over the words of their likeliest
    language's probability, from 0 where all languages are as likely to 1: it is high in a text whose words are clear, also
    if they are of several languages. A null text or one without a letter is ``und`` with score and certainty 0, and so is
    everything when nothing can be learnt; with one language every word is certain. Null ids, repeated rows and other columns are carried along; an empty table
    gives an empty result. Scoring needs no shuffle; the model's size is fixed by its parameters.
    """
    bounded_batches(docs.sparkSession)
    crf = fit(training_texts(docs, usable, id_col, text_col, lang_col))
    rows = text_rows(docs, text_col, carry)
    fields = [rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType())]
    if with_words:
        fields.append(T.StructField("words", T._parse_datatype_string("array<struct<word:string,lang:string>>")))
    return rows.mapInArrow(language_rows(crf, with_words, text_col), T.StructType(fields))


def held_out(id_col: str = "doc_id"):
    """Documents that never train: a third, by checksum of the id, and those without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))
