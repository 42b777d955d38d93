"""Runs of words that repeat with a period, found through a Re-Pair grammar of each text.

Re-Pair goes in rounds: in each, pairs of neighbouring symbols that occur twice in a text become nonterminals, where pairs overlap the
more frequent one (ties: by a hash, so that the grammar stays shallow). What is left once no pair repeats is paired up into a balanced
tree. Every maximal run lies inside the expansion of some node of that derivation tree and crosses the border between its two children.
So runs are looked for once per distinct nonterminal, at its border; they are translated to all places where it is derived;
intervals of one period that overlap by a period belong to one run and are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import SEED, Words, bounded_batches, chunks, mix
from tributary.llm.substring import without

#: A run has at least LEAST words and REPEATS periods. GRAM words on one side of a border recur a period away: of a run's words at least
#: half lie on one side, and half of max(24, 3 q) words less q are 4 or more.
LEAST, REPEATS, GRAM = 24, 3, 4
#: Rounds of the grammar; pairs that still repeat after them are paired up like all others, with the same result.
ROUNDS = 48
#: A prime below 2**31 and two bases, for the hashes that find how far two places agree.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 742_938_285)


@dataclass
class Nodes:
    """Nodes of derivation trees: the nonterminal, and its first word, border and end in the word sequence."""

    rule: np.ndarray
    start: np.ndarray
    border: np.ndarray
    end: np.ndarray


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of equal values, and how often each number occurs."""
    _, number, count = np.unique(x, return_inverse=True, return_counts=True)
    return number.reshape(-1), count


def grammar(words: np.ndarray, doc: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> Nodes:
    """Nodes with at least ``least`` words. ``words`` are numbers below len(words), different for different texts ``doc``."""
    n = len(words)
    symbol, start, fresh = words.astype(np.int64), np.arange(n), np.ones(n, bool)
    end, nodes, made = start + 1, [], n
    for step in range(10**9):
        if len(symbol) < 2:
            break
        same_doc = doc[start[:-1]] == doc[start[1:]]
        pairing = step < rounds
        if pairing:  # a pair that did not repeat before, of symbols that are not new, does not repeat now
            live = same_doc & fresh[:-1]
            equal = live & (symbol[:-1] == symbol[1:])
            if equal.any():  # of a stretch of one symbol every second pair
                begin = np.concatenate([[True], ~equal[:-1]])
                at = np.arange(len(equal))
                odd = (at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 1
                live &= ~(equal & odd)
                live_later = np.flatnonzero(equal & odd)
            else:
                live_later = np.empty(0, np.int64)
            at = np.flatnonzero(live)
            number, count = numbered(symbol[at] * made + symbol[at + 1])
            twice = count[number] >= 2
            at, number, often = at[twice], number[twice], count[number[twice]]
            pairing = len(at) > 0
        if pairing:
            rank = np.full(len(symbol) + 1, -1, np.int64)
            # the frequency first, then the pair itself: equal neighbours are equal pairs, which were thinned out above
            tie = (mix(symbol[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbol[at + 1].astype(np.uint64) + np.uint64(SEED)) >> np.uint64(34)).astype(np.int64)
            rank[at] = (np.minimum(often, 1 << 20) << 30 | tie) + 1
            won = at[(rank[at] > rank[at - 1]) & (rank[at] >= rank[at + 1])]  # rank[-1] is the spare place
            rule = np.unique(symbol[won] * made + symbol[won + 1], return_inverse=True)[1].reshape(-1) + made
            kept = np.zeros(len(symbol), bool)
            kept[at] = kept[live_later] = True
        else:  # the rest of each text as a balanced tree
            rounds = 0
            at = np.arange(len(symbol))
            first = np.concatenate([[True], ~same_doc])
            won = np.flatnonzero(((at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0)[:-1] & same_doc)
            if not len(won):
                break
            rule = np.arange(len(won)) + made
            kept = np.zeros(len(symbol), bool)
        long = end[won + 1] - start[won] >= least
        w = won[long]
        nodes.append((rule[long], start[w], start[w + 1], end[w + 1]))
        made = int(rule.max()) + 1
        symbol[won], end[won] = rule, end[won + 1]
        kept[won] = True
        kept[np.maximum(won - 1, 0)] = True
        stay = np.ones(len(symbol), bool)
        stay[won + 1] = False
        symbol, start, end, fresh = symbol[stay], start[stay], end[stay], kept[stay]
    parts = [np.concatenate(c) for c in zip(*nodes, strict=True)] if nodes else [np.empty(0, np.int64)] * 4
    return Nodes(*parts)


class Agreement:
    """How many words two places of a sequence have in common, forwards and backwards, by binary search over hashes of ranges."""

    def __init__(self, words: np.ndarray):
        n, self.words = len(words), words
        self.power, self.sums = [], []
        value = (mix(words.astype(np.uint64) + np.uint64(SEED)) >> np.uint64(34)).astype(np.int64) + 1
        for base in BASES:
            power = np.ones(n + 1, np.int64)
            width = 1
            step = base
            while width <= n:
                power[width:2 * width] = power[: len(power[width:2 * width])] * step % PRIME
                step, width = step * step % PRIME, 2 * width
            sums = np.zeros(n + 1, np.int64)
            for i in range(0, n, 1 << 20):  # sums of a block stay below 2**52
                part = slice(i, min(n, i + (1 << 20)))
                sums[part.start + 1:part.stop + 1] = (np.cumsum(value[part] * power[part] % PRIME) + sums[i]) % PRIME
            self.power.append(power)
            self.sums.append(sums)

    def equal(self, x: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from x are those from x + q."""
        out = np.ones(len(x), bool)
        for power, sums in zip(self.power, self.sums, strict=True):
            out &= (sums[x + size] - sums[x]) % PRIME * power[q] % PRIME == (sums[x + q + size] - sums[x + q]) % PRIME
        return out

    def reach(self, x: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest size up to ``most`` for which the words from x (with ``back``: before x) are those q further on."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            fits = self.equal(x - middle if back else x, q, middle)
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle - 1, high)
        return low


def candidates(nodes: Nodes, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, base, q): periods up to a third of the node's words for which GRAM words beside the border recur q words away, which
    starts the comparison at ``base``."""
    starts, grams = words.windows(GRAM)
    n = len(words.hashes)
    number, count = numbered(grams)
    order = np.lexsort((starts, number))
    gram = np.full(n + 1, -1, np.int64)
    gram[starts] = number
    place = np.zeros(n + 1, np.int64)
    place[starts[order]] = np.arange(len(order))
    sorted_at = starts[order]
    keys = number[order] * (n + 1) + sorted_at
    most = (nodes.end - nodes.start) // REPEATS
    node, base, period = [], [], []
    for right in (True, False):
        at = nodes.border if right else nodes.border - GRAM
        usable = np.flatnonzero((at >= nodes.start) & (at + GRAM <= nodes.end))
        usable = usable[gram[at[usable]] >= 0]
        usable = usable[count[gram[at[usable]]] > 1]
        a, g = at[usable], gram[at[usable]]
        if right:
            first = place[a] + 1
            last = np.searchsorted(keys, g * (n + 1) + a + most[usable], side="right")
        else:
            first = np.searchsorted(keys, g * (n + 1) + np.maximum(a - most[usable], 0), side="left")
            last = place[a]
        size = np.maximum(last - first, 0)
        which = np.repeat(np.arange(len(usable)), size)
        other = sorted_at[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        node.append(usable[which])
        base.append(a[which] if right else other)
        period.append(np.abs(other - a[which]))
    node, base, period = map(np.concatenate, (node, base, period))
    inside = (base >= nodes.start[node]) & (base + period + GRAM <= nodes.end[node])
    return node[inside], base[inside], period[inside]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs (doc, start, end, q), each with its smallest period: intervals of one period that share q words are one run."""
    order = np.lexsort((-end, start, q, doc))
    doc, start, end, q = doc[order], start[order], end[order], q[order]
    if not len(doc):
        return doc, start, end, q
    group = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])]))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(group * wide + end) - group * wide
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] + q[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    doc, start, q, end = doc[first], start[first], q[first], reach[np.append(first[1:], len(new)) - 1]
    order = np.lexsort((q, end, start, doc))
    doc, start, end, q = doc[order], start[order], end[order], q[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    return doc[new], start[new], end[new], q[new]


def runs(words: Words) -> tuple[np.ndarray, ...]:
    """doc, start, end, period of all runs of some texts, by document, start and period; words count through all texts."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if len(doc) < LEAST:
        return (np.empty(0, np.int64),) * 4
    own = numbered(words.hashes ^ mix(doc.astype(np.uint64) + np.uint64(SEED)))[0]  # other numbers in other texts
    nodes = grammar(own, doc)
    _, once, rule = np.unique(nodes.rule, return_index=True, return_inverse=True)
    single = Nodes(nodes.rule[once], nodes.start[once], nodes.border[once], nodes.end[once])
    node, base, q = candidates(single, words)
    if not len(node):
        return (np.empty(0, np.int64),) * 4
    agree = Agreement(own)
    start = base - agree.reach(base, q, base - single.start[node], True)
    end = base + q + agree.reach(base, q, single.end[node] - base - q, False)
    long = end - start >= np.maximum(LEAST, REPEATS * q)
    node, start, end, q = node[long], start[long], end[long], q[long]
    order = np.lexsort((q, start, node))  # the same run from both sides of its border, or a multiple of its period
    node, start, end, q = node[order], start[order], end[order], q[order]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(node) else np.empty(0, bool)
    node, start, end, q = node[new], start[new], end[new], q[new]
    lists = np.searchsorted(node, np.arange(len(once) + 1))  # translate to every place where the nonterminal is derived
    size = np.diff(lists)[rule.reshape(-1)]
    which = np.repeat(np.arange(len(nodes.rule)), size)
    found = np.repeat(lists[rule.reshape(-1)] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    shift = nodes.start[which] - single.start[node[found]]
    return merged(doc[nodes.start[which]], start[found] + shift, end[found] + shift, q[found])


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words = Words(part.column("text"))
            doc, start, end, q = runs(words)
            cover = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(cover, start + q, 1)
            np.add.at(cover, end, -1)
            rest = without(part, words, np.cumsum(cover)[:-1] > 0, False)
            items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - words.first[doc], end - start, q)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)), items)
            yield pa.record_batch([part.column("row"), rest.column("n_words"), lists, rest.column("kept")], names=["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns row (the columns ``carry`` of ``docs``, default all), n_words, runs (start, length and period of each, by start and
    period) and collapsed: the words without those that a run contains after its first period, joined by one space.

    A run is a stretch of at least LEAST words and REPEATS periods whose words equal those a (smallest) period before, and that no
    neighbouring word extends. Null, empty and short texts have none; equal rows get equal results; null ids and other
    columns of any name are carried along; an empty table gives an empty result. Nothing is shuffled: a text is one task's work,
    near-linear in its words in time and memory.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select((F.struct(*carry) if carry else F.struct("*")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run_rows, T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUN),
                                                   T.StructField("collapsed", T.StringType())]))
