"""The classifier chain against plain versions of its steps."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import toxicity as tox
from tributary.llm.queries import op4_toxicity

LABELS = "doc_id long, a int, b int"


def talk(i):
    """Every third text is rude, every sixth also vile; the other words say nothing."""
    rude, vile = i % 3 == 0, i % 6 == 0
    return " ".join([f"w{(i * 7 + j * j) % 40}" for j in range(20)] + ["Rude!"] * rude + ["vilest"] * vile), int(rude), int(vile)


@pytest.fixture
def categories(spark):
    return {"a": F.col("a") == 1, "b": F.col("b") == 1}


@pytest.fixture(scope="module")
def texts():
    return [talk(i) for i in range(240)]


def test_features_are_the_most_telling_ones(spark, texts, scratch):
    """Counted by Spark over several tasks, chosen as a plain count chooses them."""
    sample = spark.createDataFrame([(t, [bool(a), bool(b)]) for t, a, b in texts], "text string, y array<boolean>").repartition(5)
    positive = [sum(a for _, a, _ in texts), sum(b for *_, b in texts)]
    docs = [{f for w in set(tox.WORD.findall(t.lower())) for f in tox.features(w)} for t, *_ in texts]
    seen, want = Counter(f for d in docs for f in d), set()
    for c, p in enumerate(positive):
        rate = p / len(texts)
        hits = Counter(f for d, x in zip(docs, texts, strict=True) if x[1 + c] for f in d)
        score = {f: (hits[f] - n * rate) ** 2 / max(n * rate * (1 - rate), 1e-9) for f, n in seen.items() if n >= tox.FREQUENT}
        want |= set(sorted((f for f, s in score.items() if s >= tox.TELLING), key=lambda f: (-score[f], f))[:tox.FEATURES])
    assert tox.telling(sample, 2, len(texts), positive) == sorted(want) and "rude" in want and "-lest" in want


def test_later_models_learn_from_out_of_fold_probabilities(texts, monkeypatch):
    """What the second model is given for a text comes from models that never saw the text's fold."""
    calls = []
    monkeypatch.setattr(tox, "logistic", lambda rows, dense, y, n, own=tox.logistic: calls.append((rows, dense, y)) or own(rows, dense, y, n))
    presence = tox.Presence(["rude", "vilest", "w"])
    rows = tox.as_rows(presence.lists([t for t, *_ in texts]))
    fold = np.array([zlib.crc32(t.encode()) % tox.FOLDS for t, *_ in texts])
    y = np.array([[a, b] for _, a, b in texts], bool)
    models = tox.fitted(rows, fold, y, 3)
    assert len(models) == 2 and len(calls) == 2 + tox.FOLDS and calls[-1][1].shape == (240, 1)
    given = calls[-1][1][:, 0]
    for f in range(tox.FOLDS):
        train = fold != f
        w = tox.logistic(rows.take(train), np.zeros((train.sum(), 0)), y[train, 0].astype(float), 3)
        assert np.allclose(given[~train], tox.predicted(w, rows.take(~train), np.zeros(((~train).sum(), 0)), 3))
    whole = tox.predicted(models[0], rows, np.zeros((240, 0)), 3)
    assert not np.allclose(given, whole)


def test_logistic_like_plain_gradient_steps(texts):
    """Weights of the sparse rows are those of the same steps over a dense matrix."""
    lists = tox.Presence(["rude", "vilest", "w", "w1"]).lists([t for t, *_ in texts])
    x = np.array([[f in own for f in range(4)] for own in lists], float)
    dense, y = np.linspace(0, 1, 240)[:, None], np.array([a for _, a, _ in texts], float)
    full = np.concatenate([x, dense, np.ones((240, 1))], 1)
    w, grown = np.zeros(6), np.full(6, 1e-8)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(tox.ROUNDS):
        gradient = full.T @ (y - 1 / (1 + np.exp(-full @ w))) / 240
        gradient[:-1] -= tox.DECAY * w[:-1]
        grown += gradient**2
        w += tox.RATE * gradient / np.sqrt(grown)
    assert np.allclose(tox.logistic(tox.as_rows(lists), dense, y, 4), w)


def test_labels_without_documents_long_texts_and_clashing_columns(spark, documents, texts, categories):
    """Labels of absent documents take no place in the sample, long texts train, and columns of any name stay."""
    pairs = [(i, t + " pad" * (30_000 if i == 3 else 0)) for i, (t, *_) in enumerate(texts)]
    docs = documents([*pairs, (500, None), (501, "")]).withColumns({c: F.lit(i) for i, c in enumerate(["p_a", "y", "h", "__id", "found"])})
    labels = spark.createDataFrame([(10_000 + i, 1, 1) for i in range(900)] + [(i, a, b) for i, (_, a, b) in enumerate(texts)] + [(500, 1, 1), (None, 1, 1), (7, None, 1)], LABELS)
    out = {r.row.doc_id: r for r in tox.toxicity(docs, labels, categories, sample=240).collect()}
    assert len(out) == 242 and all((out[i].a, out[i].b) == (bool(a), bool(b)) for i, (_, a, b) in enumerate(texts))
    assert out[0].row.found == 4 and out[500].p_a == out[501].p_a
    assert tox.sampled(docs, labels, categories, "doc_id", "text", 50).count() == 50


def test_query_over_its_tables(spark, documents, texts, tmp_path):
    """Null and repeated rows, an empty table, and the same result twice."""
    docs = documents([*((i, t) for i, (t, *_) in enumerate(texts)), (None, texts[0][0]), (0, texts[0][0])])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame([(i, 1 - a, b) for i, (_, a, b) in enumerate(texts)], "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    first, again = (sorted(map(repr, op4_toxicity(spark, str(tmp_path)).collect())) for _ in range(2))
    assert first == again and len(first) == 242
    rows = op4_toxicity(spark, str(tmp_path)).where("doc_id >= 0").collect()
    assert all((r.low_quality, r.toxic) == (r.doc_id % 3 == 0, r.doc_id % 6 == 0) for r in rows)
    documents([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    marks.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert op4_toxicity(spark, str(tmp_path / "none")).count() == 0
