"""Near-duplicates and repeated spans against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import brute
from tributary.llm.common import Words
from tributary.llm.components import components
from tributary.llm.minhash import REGISTERS, compared, near_duplicates, registers
from tributary.llm.substring import without_repeats


def corpus(seed, words=120, copies=40):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    base, passage, short = say(words), say(60), say(20)
    docs = [" ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(copies):  # near copies of all degrees, chains of them
        w = list(base if k % 3 else docs[-1].split())
        for _ in range(k % 7):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((" " if k % 2 else "\n\t").join(w))
    docs += [" ".join(say(30) + passage + say(k)) for k in range(0, 40, 5)] + [" ".join(say(50) + short + say(50)) for _ in range(8)]
    docs += [None, "", "  \n", "one", "one", "Two words", "two WORDS", "a b c", "a b c d", " ".join(["ha"] * 200), " ".join(["ha", "ho"] * 90), " ".join(passage * 3)]
    docs += ["é\u00a0ß 日本 " * 20, "tail " + " ".join(base[60:]), " ".join(base[:60]) + " head"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, window, anchor", [(1, 35, 12), (2, 35, 20), (3, 6, 3), (4, 10, 10)])
def test_repeated_windows(documents, scratch, seed, window, anchor):
    pairs = corpus(seed)
    out = without_repeats(documents(pairs), scratch, window=window, anchor=anchor, carry=["doc_id"]).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute.kept_words(pairs, window)


@pytest.mark.parametrize("labels", [0, 2])
def test_spans_are_checked_where_labels_agree_by_chance(documents, scratch, labels):
    """Paths of the same anchors with other words between them: their links are cut and their windows counted."""
    r = random.Random(7)
    say = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    left, right = say(14), say(14)
    pairs = corpus(5, copies=12) + [(1000 + i, " ".join(say(40) + left + (["same"] * 20 if i < 2 else say(20)) + right + say(40))) for i in range(6)]
    out = without_repeats(documents(pairs), scratch, carry=["doc_id"], labels=labels).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute.kept_words(pairs, 35)


@pytest.mark.parametrize("seed, shingle", [(1, 4), (2, 5), (3, 2)])
def test_components(documents, scratch, seed, shingle):
    pairs = corpus(seed)
    out = near_duplicates(documents(pairs), scratch, shingle=shingle, carry=["doc_id"]).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == brute.near_components(pairs, shingle, 80)


def test_nulls_repeats_and_empty_tables(documents, scratch):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents([(None, text), (7, text), (7, text), (None, None), (3, None)]).withColumns({"row": F.lit(1), "c": F.lit(2), "r1": F.lit(3), "h": F.lit(4)})
    near = near_duplicates(docs, scratch)
    assert sorted((r.row.text is None, r.id or 0, r.component_id or 0) for r in near.collect()) == [(False, 0, 7), (False, 7, 7), (False, 7, 7), (True, 0, 0), (True, 3, 3)]
    assert near.select("row.*").columns == docs.columns
    cut = without_repeats(docs, scratch)
    assert sorted((r.row.text is None, r.n_words, r.n_removed, r.kept) for r in cut.collect()) == [(False, 50, 50, "")] * 3 + [(True, 0, 0, "")] * 2
    for f in (near_duplicates, without_repeats):
        assert f(documents([]), scratch).count() == 0


def test_components_of_chains_and_hubs(spark, scratch):
    links = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(7, 7), (300, 300), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 0 for i in range(50)} | {300: 300, 200: 200, 201: 200}


def test_estimates_are_near_the_truth():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        a, b, both = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (int(400 * (1 - share)), int(400 * (1 - share)), int(800 * share)))
        true = len(both) / (len(a) + len(b) + len(both))
        flat, sizes = np.concatenate([a, both, b, both]), np.array([len(a) + len(both), len(b) + len(both)])
        regs = registers(flat, sizes)
        union = registers(np.concatenate([a, b, both]), np.array([len(a) + len(b) + len(both)]))
        assert (np.maximum(regs[0], regs[1]) == union[0]).all()  # sketches merge
        assert abs(compared(regs[:1], regs[1:], sizes[:1], sizes[1:])[0] - true) < 4.5 * (true * (1 - true) / REGISTERS) ** 0.5 + 0.02


def test_words_and_windows_do_not_depend_on_place():
    texts = ["a b c", " a\tb\x0bc ", "x a b c", "", "ab c", "\u00a0a b"]
    w = Words(pa.array(texts))
    assert list(np.diff(w.first)) == [3, 3, 4, 0, 2, 2]
    starts, hashes = w.windows(3)
    assert hashes[0] == hashes[1] == hashes[3] and len(set(hashes)) == 2
    assert w.hashes[0] == w.hashes[3] == w.hashes[7] != w.hashes[12]
