"""Language, toxicity, URL rules, archives and vectors."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm.ann import nearest
from tributary.llm.language import LONGEST, PER_LANGUAGE, held_out, identified, training_texts
from tributary.llm.toxicity import toxicity
from tributary.llm.url_filter import RULE_DDL, glob_rule, host_rule, judged
from tributary.llm.warc import LoserTree, archived, captures, capture_index, order, records, write_archives

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = identified(docs, ~held_out()).select("row.lang", "lang_pred", "score", held_out("row.doc_id").alias("out")).where("out")
    right, low, high = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right > 0.98 and 0 <= low <= high <= 1


def test_code_switched_words(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang in ('en', 'de')")
    mixed = [" ".join(r.text.split()[:60]) for lang in ("en", "de", "en") for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(1).collect()]
    train = docs.select("doc_id", "text", "lang")
    both = train.unionByName(spark.createDataFrame([(-1, " ".join(mixed), None), (-2, None, None), (-3, "12 !! ²", "de"), (-3, "12 !! ²", "de"), (None, "", None)], train.schema))
    out = {r.row.doc_id: r for r in identified(both, F.col("doc_id") >= 0, with_words=True).where("coalesce(row.doc_id, -9) < 0").collect()}
    tags = [w.lang for w in out[-1].words]
    assert np.mean([t == "en" for t in tags[:55]]) > 0.9 and np.mean([t == "de" for t in tags[65:115]]) > 0.9
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (-2, -3, None))
    assert identified(documents([]), F.lit(True)).count() == 0
    assert [r.lang_pred for r in identified(documents([(1, "some words")], lang=None), F.lit(True)).collect()] == ["und"]


def test_languages_of_long_texts_and_copies(spark):
    """A language with long documents only is learnt, and copies take no more than one place of a language's sample."""
    r = random.Random(5)
    say = lambda letters, n: " ".join("".join(r.choices(letters, k=5)) for _ in range(n))
    rows = [(i, "12 " * 9_000 + say("abcde", 8_000), "aa") for i in range(6)] + [(100 + i, say("vwxyz", 30), "zz") for i in range(40)]
    rows += [(200 + i, say("lmnop", 30) if i < 40 else "lone copy", "ll") for i in range(40 + 5 * PER_LANGUAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    texts = training_texts(docs, F.lit(True), "doc_id", "text", "lang")
    by = {lang: [t for t, x in texts if x == lang] for lang in ("aa", "ll", "zz")}
    assert {k: (len(v), len(set(v))) for k, v in by.items()} == {"aa": (6, 6), "ll": (41, 41), "zz": (40, 40)}
    assert max(map(len, by["aa"])) <= LONGEST and all(w == "12" or len(w) == 5 for t in by["aa"] for w in t.split())
    out = identified(docs, F.lit(True)).where("row.text <> 'lone copy'").collect()
    assert all(x.lang_pred == x.row.lang for x in out)
    many = docs.unionByName(spark.createDataFrame([(5_000 + i, say("abcde", 5), "aa") for i in range(2 * PER_LANGUAGE)], docs.schema))
    assert all(len(t) < 100 for t, x in training_texts(many, F.lit(True), "doc_id", "text", "lang") if x == "aa")


def test_toxicity(spark, documents):
    r = random.Random(3)
    word = lambda k: f"{k}{'abcdefghij'[r.randrange(10)]}"
    clean = lambda: [word("plain") + word("word") for _ in range(60)]
    texts, marks = [], []
    for i in range(600):
        mild, severe = i % 3 == 0, i % 6 == 0
        texts.append(" ".join(clean() + ["Rude!"] * mild + ["rude-vile,"] * severe))
        marks.append((i, int(mild), int(severe)))
    docs = documents([*enumerate(texts), (900, None), (901, ""), (None, "x RUDE. y")])
    labels = spark.createDataFrame([*marks[:400], (400, None, 1)], "doc_id long, a int, b int")
    categories = {"insult": F.col("a") == 1, "threat": F.col("b") == 1}
    out = {r.row.doc_id: r for r in toxicity(docs, labels, categories).collect()}
    assert all(out[i].insult == bool(a) and out[i].threat == bool(b) for i, a, b in marks)
    assert out[None].insult and not out[None].threat and not out[900].insult and out[900].p_insult == out[901].p_insult
    assert toxicity(documents([]), labels, categories).count() == 0
    assert not any(r.insult for r in toxicity(docs, labels.limit(0), categories).collect())


RULES = [host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"), glob_rule("*/ads/*", "block"), glob_rule("*track*", "block")]


def test_url_rules(spark, scratch):
    urls = ["http://a.NET/x", "https://example.net/en/1?q=/ads/", "http://example.net/en", "http://x.example.net/ads/en/", "http://net", "http://net?x", "http://net/",
            "http://planet/x", "nothing", None, "", "://", "http://o.org/ads/1", "http://o.org/mytracker", "ftp://user@o.org:80/a#b://net/", "http://a.net/\nx", "http://a.net.evil/"]
    rows = spark.createDataFrame([*enumerate(urls), (None, "http://a.net/"), (3, urls[3])], "page_id long, url string").withColumns({"rule": F.lit(1), "token": F.lit(2)})
    got = judged(rows, spark.createDataFrame(RULES, RULE_DDL), scratch).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(urls) + 2
    assert [by[i].rule for i in range(len(urls))] == ["net/", "example.net/en/", "net/"] + ["*/ads/*"] + [None, None, "net/", None, None, None, None, None, "*/ads/*", "*track*", None, "net/", None]
    assert by[0].host == "a.net" and by[0].path == "/x" and by[14].host == "user@o.org:80" and (by[9].host, by[9].path) == ("", "")
    assert {r.verdict for r in got if r.rule is None} == {"allow"} and by[None].rule == "net/"
    assert judged(rows, spark.createDataFrame([], RULE_DDL), scratch).where("verdict <> 'allow'").count() == 0
    assert judged(rows.limit(0), spark.createDataFrame(RULES, RULE_DDL), scratch).count() == 0


def test_host_rules_stay_in_the_host(spark, scratch):
    """A host in the path is no host; one with a line break has its subdomains' rules."""
    urls = ["http://example.com/go/foo.net/x", "http://other.org/web/www.example.net/en/1", "http://o.org/x.net/", "http:///x.net/", "http://a\n.net/x", "http://a\nb.example.net/en/",
            "http://o.org\n/x.net/en/", "http://a.net/x.example.net/en/"]
    rows = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    by = {r.page_id: r.rule for r in judged(rows, spark.createDataFrame(RULES, RULE_DDL), scratch).collect()}
    assert [by[i] for i in range(len(urls))] == [None, None, None, None, "net/", "example.net/en/", None, "net/"]


def test_archives(spark, scratch):
    big, r = "é" * 600, random.Random(1)
    html = [big, big, big, "x" * 999, "x" * 999, None, "", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 100, "😀\r\n" * 300, "z" * 200_000]
    pages = [(i, r.choice(["http://B.example/2", "https://a.example/1?x=1", "http://a.example/\r\nX: y", None]), h) for i, h in enumerate(html)] + [(None, None, big), (2, "http://dup/", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rows = archived(df, scratch).collect()
    assert [order(x.asDict()) for x in rows] == sorted(order(x.asDict()) for x in rows) and len(rows) == len(pages)
    want = sorted(((i is None, i or 0), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in pages)
    assert sorted(((x.page_id is None, x.page_id or 0), x.payload_bytes, x.payload_digest) for x in rows) == want
    kinds = {x.page_id: (x.record_type, x.refers_to) for x in rows}
    assert kinds[2] == ("response", None) and kinds[0] == kinds[1] == kinds[None] == ("revisit", 2) and kinds[3] == kinds[4] == ("response", None)
    assert archived(df.limit(0), scratch).count() == 0


def test_merge_over_several_ranges(spark, scratch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(5)
    rows = captures(pages, scratch)
    path = scratch.path("warc")
    write_archives(rows, path, 200_000)
    keys = sorted(order(r.asDict()) for r in rows.select("urlkey", "date", "page_id").collect())
    index = capture_index(spark, path, scratch, 40)
    assert index.rdd.getNumPartitions() == -(-len(keys) // 40) and [order(x.asDict()) for x in index.collect()] == keys
    assert index.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200


def test_archives_are_cut_by_bytes(spark, scratch):
    """Large pages that stand together do not fill one file; a page above the limit has a file of its own."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.when(
        F.col("id").between(1000, 1030), F.repeat(F.lit("x"), 90_000)).when(F.col("id") == 2000, F.repeat(F.lit("y"), 400_000)).otherwise(F.repeat(F.lit("z"), 500)).alias("html"))
    rows, path = captures(pages.coalesce(1), scratch, 10**9), scratch.path("warc")
    write_archives(rows, path, 200_000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert sorted(sizes)[-2] <= 200_000 < sorted(sizes)[-1] < 402_000 and len(sizes) > 30
    assert capture_index(spark, path, scratch).count() == 3000


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(({"urlkey": r.choice("abc"), "date": "", "page_id": r.choice([None, *range(9)])} for _ in range(r.randrange(12))), key=order) for _ in range(k)]
    assert [order(x) for x in LoserTree(runs)] == sorted(order(x) for run in runs for x in run)
    assert list(LoserTree([])) == []


def test_archive_reader_stops_at_damage():
    with pytest.raises(ValueError):
        list(records(b"NOT A RECORD\r\n\r\n"))


def exact_neighbours(vectors, k):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for q in sorted({i for i in ids if i % 20 == 0}):
        v = x[ids == q][0]
        s = np.array([(row * v).sum() for row in x])
        keep = np.flatnonzero(ids != q)
        best = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
        out[q] = list(zip(ids[best].tolist(), s[best].tolist(), strict=True))
    return out


def test_recall_and_ties(spark, scratch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16))
    x = (centres[r.integers(0, 30, 6000)] + 0.3 * r.normal(size=(6000, 16))) * r.uniform(0.5, 2, (6000, 1))
    x[100:400] = x[100]  # one vector many times
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    bad = [(6000, None), (6020, [0.0] * 16), (6040, [float("nan")] * 16), (6060, [None] + [1.0] * 15), (6080, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([*vectors, *bad], "vec_id long, embedding array<float>").withColumn("leaf", F.lit("x"))
    rows = nearest(df, scratch, F.col("vec_id") % 20 == 0).collect()
    want, got = exact_neighbours(vectors, 20), {}
    for row in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 20 for q in want]) >= 0.9
    assert all(got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) for q in got)
    true = dict(vectors)
    assert all(s == pytest.approx(np.dot(np.array(true[q]), np.array(true[v])), abs=1e-12) for q in got for v, s in got[q])


def test_few_vectors(spark, scratch):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, scratch, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0)]
    assert nearest(df.limit(0), scratch, F.lit(True)).count() == 0
