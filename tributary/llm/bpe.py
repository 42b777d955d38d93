"""Byte-level BPE, encoded along a trie of distinct words.

A prefix's encoding is its last token after the encoding of the rest, so one token per prefix is all the state there is: the longest
vocabulary entry that ends the prefix and stays apart from the token before it. Words are walked in sorted order, which is the
depth-first order of their trie; what two neighbours share is a stack that is kept, and each shared prefix is worked out once.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import bounded_batches, chunks

#: Fixed value: how the byte-level tokenizers split text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the tokenizers define it (the regex module also counts four separators).
SPACE = r"[\t-\r \x85\xa0  -     　]"
#: Distinct words that a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 400_000
#: A space after white space: only there does cutting at single spaces not give the words.
UNSAFE = re.compile(r"\s ")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A tokenizer file's vocabulary, merges and added tokens. Ids must follow the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        spell = lambda s: bytes(letters[c] for c in s)
        vocabulary = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {spell(s): i for s, i in vocabulary.items() if s not in self.added}
        self.bytes: list[bytes] = [b""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.sizes = [len(b) for b in self.bytes]
        self.spell_out()
        self.parts, self.merged = [(i, i) for i in range(len(self.bytes))], {}
        before = -1
        for merge in spec["model"]["merges"]:
            left, right = (spell(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, made = (self.ids[left], self.ids[right]), self.ids[left + right]
            if made <= before:
                raise ValueError("ids must follow the order of the merges")
            before, self.merged[pair], self.parts[made] = made, made, pair
        self.pattern = regex.compile(PATTERN.replace(r"[^\s", "[^" + SPACE[1:-1]).replace(r"\s", SPACE).replace(r"\S", "[^" + SPACE[1:]))
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are their own encoding: no merge that would come earlier joins the border, at any level."""
        parts, merged, limit = self.parts, self.merged, len(self.bytes) + 1
        while True:
            made = merged.get((left, right))
            if made is not None and made < limit:
                return False
            if left > right:
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def spell_out(self) -> None:
        """An automaton of the vocabulary: a state is the longest suffix that begins some token, ``endings`` has the tokens that end there,
        longest first."""
        goto, own = {}, [None]
        for b, token in self.ids.items():
            at = 0
            for x in b:
                key = at << 8 | x
                at = goto.get(key)
                if at is None:
                    at = goto[key] = len(own)
                    own.append(None)
            own[at] = (token, len(b))
        self.goto, self.fall = goto, [0] * len(own)
        levels = sorted(goto.items(), key=lambda kv: kv[1])
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in levels:
            children.setdefault(key >> 8, []).append((key & 255, to))
        self.endings: list[tuple] = [()] * len(own)
        row = [0]
        while row:  # breadth first: a suffix is shorter than what it ends
            after = []
            for at in row:
                for x, to in children.get(at, ()):
                    self.fall[to] = self.step(self.fall[at] << 8 | x) if at else 0
                    rest = self.endings[self.fall[to]]
                    self.endings[to] = (own[to], *rest) if own[to] else rest
                    after.append(to)
            row = after

    def step(self, key: int) -> int:
        """The state after a byte (key: state << 8 | byte)."""
        state, byte = key >> 8, key & 255
        while True:
            to = self.goto.get(state << 8 | byte)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.fall[state]

    def learn(self, words: set[str]) -> None:
        """Encodings of new words, by a depth-first walk of their trie."""
        apart, endings, go, step = self.apart, self.endings, self.goto.get, self.step
        if len(apart) > 4 * REMEMBERED:
            apart.clear()
        last, states, before = [-1], [0], b""
        for name in sorted(words):  # code points sort as their bytes
            b = name.encode()
            shared, most = 0, min(len(b), len(before))
            while shared < most and b[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], states[shared + 1:]
            state = states[shared]
            for d in range(shared + 1, len(b) + 1):
                key = state << 8 | b[d - 1]
                state = go(key)
                if state is None:
                    state = step(key)
                states.append(state)
                for token, size in endings[state]:
                    left = last[d - size]
                    if left < 0:
                        break
                    key = left << 20 | token
                    fits = apart.get(key)
                    if fits is None:
                        fits = apart[key] = self.stay_apart(left, token)
                    if fits:
                        break
                last.append(token)
            out, d = array("i"), len(b)
            while d:
                token = last[d]
                out.append(token)
                d -= self.sizes[token]
            out.reverse()
            self.words[name] = out.tobytes()
            before = b

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. Text is cut at single spaces; words and cuts are looked up, new ones learnt together."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.tails) > REMEMBERED:
            self.tails.clear()
        find, plans, new, fresh = self.pattern.findall, [], set(), set()
        for text in texts:
            parts = self.special.split(text) if self.special and any(s in text for s in self.added) else [text]
            plan = []
            for k, part in enumerate(parts):
                if k % 2:
                    plan.append(np.array([self.added[part]], np.int32).tobytes())
                elif part:
                    if UNSAFE.search(part):
                        head, tail = find(part), []
                    else:
                        first, *tail = part.split(" ")
                        head = find(first)
                        new.update(tail)
                    fresh.update(head)
                    plan.append((head, tail))
            plans.append(plan)
        new -= self.tails.keys()
        cut = {t: find(" " + t) for t in new}
        fresh.update(*cut.values())
        self.learn(fresh - self.words.keys())
        word, tail_of = self.words.__getitem__, self.tails
        for t, words in cut.items():
            tail_of[t] = word(words[0]) if len(words) == 1 else b"".join(map(word, words))
        tail_of = tail_of.__getitem__
        return [np.frombuffer(b"".join(p if isinstance(p, bytes) else b"".join(map(word, p[0])) + b"".join(map(tail_of, p[1])) for p in plan), np.int32)
                for plan in plans]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One per worker process and file."""
    return ByteBpe(path)


def id_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


def encoded_rows(path: str, decoded: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                arrays = bpe.encode(part.column("text").to_pylist())
                columns = [part.column("row"), id_lists(arrays)]
                if decoded:
                    columns.append(pa.array([bpe.decode(a) for a in arrays], pa.string()))
                yield pa.record_batch(columns, names=["row", "ids", "decoded"][: len(columns)])
    return rows


def encoded(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Columns row (the columns ``carry``, default all), ids and, if asked for, decoded (the text that the ids stand for).

    ``path`` is a byte-level BPE file that every executor can open. Whole texts are encoded; strings of added tokens become
    their ids; null and empty texts have no ids; repeated rows are encoded each; an empty table gives an empty result. There is no
    shuffle: words are gathered per task, and a worker remembers a bounded number of them.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select((F.struct(*carry) if carry else F.struct("*")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    return rows.mapInArrow(encoded_rows(path, decoded), T.StructType(fields))


def decoded_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])
    return rows


def decoded(encoded: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Columns row and text of a table with id arrays; null arrays give empty texts, broken byte sequences U+FFFD."""
    rows = encoded.select((F.struct(*carry) if carry else F.struct("*")).alias("row"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decoded_rows(path), T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
