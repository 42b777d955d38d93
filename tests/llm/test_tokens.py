"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tributary.llm.bpe import ByteBpe, decoded, encoded
from tributary.llm.library import LibraryBpe
from tributary.llm.packing import cuts, packed

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " ", "  ", " a", "a ", "a  b", "a   b", "a\n  b", "a\n b", "a \n b", "a\n \nb\n", "x <|endoftext|> y<|endoftext|>", "it's I'll we've 'S",
         "\x1c \x1d a\x1f b", "\u3000 a \u200b b\x85c \u2028 \xa0 d", "½² 12３ ab", "héllö wörld 😀😀 👨‍👩‍👧", "a" * 300, " " * 200, "-" * 500, "\t\t a\r\n", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module", params=[ByteBpe, LibraryBpe])
def bpe(request):
    return request.param(PATH)


def agree(bpe, library, texts):
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_hard_texts(bpe, library):
    agree(bpe, library, TEXTS)
    agree(bpe, library, [f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in [*range(1, 0xD800, 7), *range(0xE000, 0x11000, 13)]])


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abeTh 'sdrl\n\t.,!1²é日 "), max_size=40))
def test_any_text(bpe, library, text):
    agree(bpe, library, [text])


def test_round_trip(spark, documents):
    docs = documents(enumerate([*TEXTS, None]))
    out = encoded(docs, PATH, carry=["doc_id"], decoded=True)
    assert {r.row.doc_id: r.decoded for r in out.collect()} == dict(enumerate([*TEXTS, ""]))
    back = decoded(out.select("row.doc_id", "ids"), PATH, carry=["doc_id"])
    assert {r.row.doc_id: r.text for r in back.collect()} == dict(enumerate([*TEXTS, ""]))
    assert encoded(documents([]), PATH).count() == 0


def test_registered_round_trip(spark, library):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in entry.queries()["op3_bpe_round_trip"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, want):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.row.doc_id][r.start:r.start + r.length]
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.row.doc_id])
        pieces[r.row.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, found in pieces.items():
        assert [s for s, _ in sorted(found)] == [0, *np.cumsum([n for _, n in sorted(found)])[:-1]] and sum(n for _, n in found) == len(want[i])
    totals = []
    for found in sequences.values():
        found.sort()
        assert [o for o, _ in found] == [0, *np.cumsum([n for _, n in found])[:-1]]
        totals.append(sum(n for _, n in found))
    assert max(totals) <= 1024
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in totals) / sum(totals)


def test_packing(spark, library, documents):
    texts = [*TEXTS, None, "no stops at all " * 2000, "Short. " * 5000, "x" * 40_000, *[f"Doc {i} says this. " * (i % 60) for i in range(600)]]
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    rows = packed(documents(enumerate(texts)), PATH, carry=["doc_id"], with_ids=True).collect()
    assert all(r.ids == want[r.row.doc_id][r.start:r.start + r.length] for r in rows)
    assert check_packing(rows, want) < 0.02
    assert packed(documents([]), PATH).count() == 0


def test_cuts_are_the_cheapest():
    """Against all ways to cut, on short streams."""
    r = np.random.default_rng(5)
    for _ in range(40):
        at = np.unique(np.concatenate([[0], r.integers(1, 40, 9), [41]]))
        cost = r.integers(0, 5, len(at))
        best = {0: 0.0}
        for j in range(1, len(at)):
            best[j] = min((best[i] + (12 - (at[j] - at[i])) + cost[j] + 1 for i in range(j) if i in best and at[j] - at[i] <= 12), default=np.inf)
        if np.isfinite(best[len(at) - 1]) and np.isfinite(list(best.values())).all():
            path = cuts(at, cost, 12)
            paid = sum(12 - (at[j] - at[i]) + cost[j] + 1 for i, j in zip(path[:-1], path[1:], strict=True))
            assert path[0] == 0 and path[-1] == len(at) - 1 and paid == best[len(at) - 1]
