"""Removal of lines that many documents share, by levelled sorted runs of line hashes. DataFrame functions only.

The index counts documents per line. Every batch of documents drops what the runs have settled already (a merge anti join) and adds the
rest as a sorted run of its own; when a level holds FANOUT runs, they are merged into one run of the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import BROADCAST_ROWS, Scratch, keyed

#: Runs of one level that are merged into one of the next. Batches that one table is dealt into.
FANOUT, BATCHES = 4, 8
#: The white space that is stripped at both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z (only these) lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def line_hashes(text: Column, min_chars: int) -> Column:
    """Per line a struct (h1, h2), 128 bits of its key; null for keys with fewer than ``min_chars`` code points."""
    def one(line: Column) -> Column:
        return F.when(F.length(line) >= min_chars, F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")))
    return F.transform(F.transform(F.split(text, "\n"), line_key), one)


class LineIndex:
    """Documents per line hash, as sorted runs (h1, h2, docs) on levels; a run's entries with ``min_docs`` documents or more are settled and
    lie apart from the open ones. A line that one run has settled enters no later run."""

    def __init__(self, scratch: Scratch, min_docs: int, fanout: int = FANOUT):
        self.scratch, self.min_docs, self.fanout = scratch, min_docs, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def write(self, counts: DataFrame, level: int) -> None:
        """A run sorted by hash over all its files, settled entries and open ones in folders of their own."""
        name, self.made = f"run-{self.made}", self.made + 1
        run = counts.select("h1", "h2", "docs", (F.col("docs") >= self.min_docs).alias("settled"))
        run = run.repartitionByRange("h1", "h2").sortWithinPartitions("settled", "h1", "h2")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, self.scratch.save(run, name, ["settled"])))

    def add(self, batch: DataFrame) -> None:
        """``batch`` has one row per line hash: h1, h2, docs (documents of the batch that hold the line)."""
        for run in self.runs():
            batch = batch.join(run.where("settled").select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.write(batch.select("h1", "h2", "docs"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one run of the next."""
        merged, self.levels[level] = self.levels[level], []
        self.write(totals([run for _, run in merged]), level + 1)
        self.scratch.drop(*(name for name, _ in merged))

    def settled(self) -> DataFrame:
        """h1, h2 of the lines that at least ``min_docs`` documents hold."""
        return totals(self.runs()).where(F.col("docs") >= self.min_docs).select("h1", "h2")


def totals(runs: list[DataFrame]) -> DataFrame:
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run)
    return whole.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))


def dropped(lines: DataFrame, settled: DataFrame, incoming: DataFrame, rows: int) -> DataFrame:
    """Those of ``lines`` (r1, r2, pos, h1, h2) that are settled.

    At most ``rows`` settled lines are broadcast. Where there are more, these are the ones that hold more than one in ``rows`` of all
    pairs of document and line, by the full counts of ``incoming``; what is left for the shuffle join has no frequent key.
    """
    keys = ["h1", "h2"]
    if settled.count() <= rows:
        return lines.join(F.broadcast(settled.select(*keys)), keys).select("r1", "r2", "pos")
    counts = incoming.join(settled.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("docs").alias("docs"))
    share = -(-incoming.agg(F.sum("docs")).first()[0] // rows)
    hot, cold = (counts.where(c).select(*keys) for c in (F.col("docs") > share, F.col("docs") <= share))
    rest = lines.join(F.broadcast(hot), keys, "left_anti").join(cold, keys)
    return lines.join(F.broadcast(hot), keys).select("r1", "r2", "pos").union(rest.select("r1", "r2", "pos"))


def kept_lines(lines: Column, at: Column) -> Column:
    """``lines`` without those at the ascending positions ``at``, as the slices between them."""
    end = F.size(at)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(at, i - 1) + 1)
    until = lambda i: F.when(i == end, F.size(lines)).otherwise(F.get(at, i))
    return F.flatten(F.transform(F.sequence(F.lit(0), end), lambda i: F.slice(lines, begin(i) + 1, until(i) - begin(i))))


def without_shared_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                         carry: list[str] | None = None, batches: int = BATCHES, fanout: int = FANOUT, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns row (the columns ``carry`` of ``docs``, default all), n_lines, n_dropped and kept (the other lines, joined by line feeds).

    Texts are cut at line feeds; null and empty texts have one empty line. A line whose key (see ``line_key``) has at least
    ``min_chars`` code points and occurs in at least ``min_docs`` documents is dropped wherever it stands. Every row is a document, rows
    with the same id or text too; a line that one document repeats counts once. Null ids and other columns of any name are
    carried along; an empty table gives an empty result. Lines are told apart by 128 bits of hash.
    """
    scratch = scratch.fresh()
    docs = keyed(docs, text_col, [id_col], carry)
    hashed = docs.select("r1", "r2", line_hashes(F.col("text"), min_chars).alias("lines"))
    each = hashed.select(F.pmod("r1", F.lit(batches)).cast("int").alias("batch"), F.explode(F.array_distinct("lines")).alias("k")).where("k IS NOT NULL")
    incoming = scratch.save(each.groupBy("batch", "k.h1", "k.h2").agg(F.count("*").alias("docs")), "incoming", ["batch"])
    index = LineIndex(scratch, min_docs, fanout)
    for b in range(batches):
        index.add(incoming.where(F.col("batch") == b))
    settled = scratch.save(index.settled(), "settled")
    lines = hashed.select("r1", "r2", F.posexplode("lines").alias("pos", "k")).where("k IS NOT NULL").select("r1", "r2", "pos", "k.h1", "k.h2")
    gone = dropped(lines, settled, incoming, rows).groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    gone = scratch.save(gone, "gone")
    scratch.keep("gone")
    n, positions = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    found = docs.join(F.broadcast(gone) if n + positions <= rows else gone, ["r1", "r2"], "left")
    found = found.select("row", "text", "at", F.split("text", "\n").alias("lines"))
    kept = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(F.col("lines"), F.col("at")), "\n"))
    return found.select("row", F.size("lines").cast("long").alias("n_lines"),
                        F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_dropped"), kept.alias("kept"))
