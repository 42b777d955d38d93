"""Runs of words with a period."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.brute import WORD
from tributary.llm import periodic
from tributary.llm.common import Words
from tributary.llm.queries import op12_periodic_runs


def plain(w):
    """(start, length, period) of all runs, by looking at every period; of a stretch the smallest one counts."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def samples(seed):
    r = random.Random(seed)
    pick = lambda letters, n: [r.choice(letters) for _ in range(n)]
    u, v = pick("abc", r.randint(1, 30)), pick("ab", 5)
    switches = sum((r.choice([["a", "b"], ["a", "a", "b"]]) * r.randint(1, 15) for _ in range(12)), [])
    return [[], ["a"] * 23, ["a"] * 24, ["a"] * 700, pick("ab", 300), pick("abcd", 9) + (u * 40)[:200] + pick("abcd", 9), fibonacci(r.randint(30, 400)),
            [str(bin(i).count("1") % 2) for i in range(300)], ((v * 3 + ["c"]) * 9)[:120] + ["a"] * 30 + v * 9, pick("abcdefgh", 90) * 3, switches]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("rounds", [periodic.ROUNDS, 2])
def test_runs_like_a_plain_search(seed, rounds, monkeypatch):
    """Also with a grammar that stops early; texts stand in one batch and do not touch."""
    monkeypatch.setattr(periodic.grammar, "__defaults__", (periodic.LEAST, rounds))
    texts = samples(seed)
    words = Words(pa.array([" ".join(w) for w in texts]))
    doc, start, end, q = periodic.runs(words)
    got = [[(s - words.first[d], e - s, p) for d, s, e, p in zip(doc, start, end, q, strict=True) if d == i] for i in range(len(texts))]
    assert got == [plain(w) for w in texts]


def test_grammar_derives_its_text_and_repeats_no_pair():
    """Nodes split into nodes; each nonterminal has one expansion; the tree over 4,096 equal or mirrored words is shallow."""
    for w in (["a"] * 4096, fibonacci(4096), [str(x) for x in np.random.default_rng(1).integers(0, 9, 4096)]):
        own = np.unique(w, return_inverse=True)[1]
        nodes = periodic.grammar(own, np.zeros(len(w), np.int64), least=2)
        assert len(nodes.rule) == len(w) - 1
        spans, expansion = {(i, i + 1) for i in range(len(w))}, {}
        for x, s, b, e in zip(nodes.rule, nodes.start, nodes.border, nodes.end, strict=True):
            assert {(s, b), (b, e)} <= spans
            spans.add((s, e))
            assert expansion.setdefault(x, (b - s, w[s:e])) == (b - s, w[s:e])
        assert sum(e - s for s, e in spans) < 40 * len(w)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    found, best = plain(w), None
    for r in found:
        best = r if best is None or r[1] * best[2] > best[1] * r[2] else best
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id is None, doc_id or 0, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found)))


def test_query_like_a_plain_search(spark, documents, tmp_path):
    r = random.Random(5)
    texts = [" ".join(w) for seed in range(14) for w in samples(seed)]
    pairs = [(i, t.replace(" ", r.choice([" ", "\t\n", "\x0b \r"]))) for i, t in enumerate(texts)] + [(500, None), (None, texts[3]), (None, texts[3]), (7, texts[8])]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in pairs) > 5
    documents(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_periodic_runs(spark, str(tmp_path))
    assert sorted((x.doc_id is None, x.doc_id or 0, *x[1:]) for x in got.collect()) == sorted(expected(*p) for p in pairs)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_empty_table_clashing_columns_and_a_long_text(documents):
    assert periodic.periodic_runs(documents([])).count() == 0
    docs = documents([(1, "x y " * 200_000)]).withColumns({c: F.lit(1) for c in ["row", "runs", "n_words", "collapsed"]})
    got = periodic.periodic_runs(docs).first()
    assert (got.n_words, [tuple(r) for r in got.runs], got.collapsed, got.row.runs) == (400_000, [(0, 400_000, 2)], "x y", 1)
