"""Lines that many documents share."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from tributary.llm.lines import LineIndex, without_shared_lines

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"


def plain(pairs, min_docs, min_chars):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    lines = [(i, (t or "").split("\n")) for i, t in pairs]
    seen = Counter(k for _, ls in lines for k in {key(x) for x in ls})
    gone = lambda x: len(key(x)) >= min_chars and seen[key(x)] >= min_docs
    return sorted(((i is None, i or 0), len(ls), sum(map(gone, ls)), "\n".join(x for x in ls if not gone(x))) for i, ls in lines)


def verdicts(df):
    return sorted(((r.row.doc_id is None, r.row.doc_id or 0), r.n_lines, r.n_dropped, r.kept) for r in df.collect())


PAIRS = [(1, "Same line\nown 1\n\n same LINE\t"), (2, "\x0bsame line\r\nÄpfel\nown 2\n"), (3, None), (4, ""), (5, "äpfel\nsame line"), (6, "Äpfel \nsame line"),
         (7, "a\n" * 3000 + "Same line\n" * 2), (7, "a\n" * 3000 + "Same line\n" * 2), (None, "own 1"), (None, "own 1"), (8, "\n\n"), (9, "x" * 200_000 + "\nown 2")]


@pytest.mark.parametrize("min_docs,min_chars,rows", [(2, 1, 500_000), (2, 0, 500_000), (3, 1, 500_000), (2, 1, 2), (2, 1, 1), (1, 1, 500_000), (1, 2, 500_000)])
def test_lines_like_a_plain_count(documents, scratch, min_docs, min_chars, rows):
    """Also where only the most frequent lines may be broadcast; any white space and case outside the fixed ones tell lines apart."""
    got = without_shared_lines(documents(PAIRS), scratch, min_docs=min_docs, min_chars=min_chars, batches=5, fanout=2, rows=rows)
    assert verdicts(got) == plain(PAIRS, min_docs, min_chars)


def test_runs_are_sorted_settled_and_merged(spark, scratch):
    """Counts add up over the levels; what is settled enters no later run."""
    index = LineIndex(scratch, 3, fanout=2)
    for b in range(5):
        index.add(spark.createDataFrame([(1, 1, 3), (2, 2, 1), (10 + b, 0, 1)], "h1 long, h2 long, docs long"))
    runs = [[(r.h1, r.docs, r.settled) for r in run.orderBy("h1").collect()] for run in index.runs()]
    assert [len(level) for level in index.levels] == [1, 0, 1]
    assert runs == [[(14, 1, False)], [(1, 3, True), (2, 4, True), (10, 1, False), (11, 1, False), (12, 1, False), (13, 1, False)]]
    assert sorted(r.h1 for r in index.settled().collect()) == [1, 2]


def test_empty_tables_and_clashing_columns(documents, scratch):
    assert without_shared_lines(documents([]), scratch).count() == 0
    docs = documents(PAIRS[:2]).withColumns({c: F.lit(1) for c in ["row", "r1", "lines", "at", "h1", "docs", "settled", "batch", "kept"]})
    got = without_shared_lines(docs, scratch, min_docs=2).collect()
    assert sorted(r.kept for r in got) == ["own 1\n", "Äpfel\nown 2\n"] and got[0].row.settled == 1


def test_query_like_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op11_line_dedup"](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(entry.oracle_sql()["op11_line_dedup"]).df()) is None and len(got)


def test_no_python_in_the_plan(spark, documents, scratch):
    plan = without_shared_lines(documents(PAIRS), scratch)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
