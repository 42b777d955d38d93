"""Stages of the pipeline."""

from collections import Counter
from random import Random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tributary.llm.queries import TOKENIZER

WORDS = [f"w{i}" for i in range(300)]
A, B, C, D = (" ".join(WORDS[k:k + 60]) for k in (0, 60, 120, 180))
NEAR = A.replace("w59", "other")


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_dedup_keeps_one_row(spark, documents):
    docs = documents([(1, A), (7, A), (7, A), (None, A), (None, B), (None, B), (2, None), (2, ""), (None, "x"), (3, C)])
    out = pipeline.exact_dedup(spark, docs, "")
    got = kept(out)
    assert out.columns == docs.columns and sum(got.values()) == 5 and all(n == 1 for n in got.values())
    assert {(i, t or "") for i, t in got} == {(7, A), (None, B), (2, ""), (None, "x"), (3, C)}


def test_near_dedup_keeps_one_row(spark, documents):
    """Groups that share their least id, or have none, are told apart; so are texts without words."""
    docs = documents([(1, A), (1, A), (1, NEAR), (5, NEAR), (None, B), (None, B + " z"), (None, C), (1, D), (2, D), (1, ""), (1, ""), (4, None), (4, " ")])
    out = pipeline.near_dedup(spark, docs, "")
    got = kept(out)
    assert out.columns == docs.columns and all(n == 1 for n in got.values())
    first = {(1, A), (1, NEAR)} & set(got)
    second = {(None, B), (None, B + " z")} & set(got)
    assert len(first) == len(second) == 1 and set(got) - first - second == {(None, C), (1, D), (1, ""), (4, None), (4, " ")}


def test_repeated_rows_and_null_ids_stay_once(spark, documents):
    docs = documents([(7, A), (7, A), (9, NEAR), (None, B), (None, B), (None, B + " z"), (3, C), (3, C + " z"), (8, D)])
    for stage in (pipeline.exact_dedup, pipeline.near_dedup, pipeline.substring_dedup):
        docs = stage(spark, docs, "")
    texts = sorted(r.text.removesuffix(" z") for r in docs.collect())
    assert texts == sorted([A, B, C, D])


def speech(letters, i, n=80):
    """Words of some letters, the same for the same number."""
    r = Random(f"{letters}{i}")
    return " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n))


def test_language_id_keeps_clean_and_mixed_text(spark, documents):
    """Clean text of each language stays, and so does text in several of them; text without letters goes, null or not."""
    known = [(i, speech(("abcde", "lmnop", "vwxyz")[i % 3], i)) for i in range(90)]
    mixed = [(200 + i, " ".join(speech(x, 300 + i, 40) for x in ("abcde", "lmnop", "vwxyz"))) for i in range(5)]
    junk = [(300, None), (301, ""), (302, "12 34 !!"), (None, "777")]
    docs = documents([*known, *mixed, *junk, known[0], (None, known[1][1])])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 90, F.element_at(F.array(F.lit("a"), F.lit("l"), F.lit("v")), (F.col("doc_id") % 3 + 1).cast("int"))))
    out = pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and kept(out) == Counter([*known, *mixed, known[0], (None, known[1][1])])
    assert pipeline.language_id(spark, documents([]), "").count() == 0


def test_packing_returns_the_pieces_of_its_documents(spark, documents):
    out = pipeline.packing(spark, documents([(1, A), (1, A), (2, None), (None, "x")]), "").collect()
    assert sorted(((r.doc_id or 0), r.start, r.length == r.doc_tokens) for r in out) == [(0, 0, True), (1, 0, True), (1, 0, True), (2, 0, True)]
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and next(r for r in out if r.doc_id == 2).length == 1
    assert pipeline.packing(spark, documents([]), "").count() == 0


def test_run_is_the_stages_one_after_the_other(spark, documents, tmp_path):
    """Each decision takes effect: what is left after all stages is what a plain version of them leaves."""
    clean = [(i, speech("abcdeuvwxyz", i, 120)) for i in range(30)]
    passage = speech("abcdeuvwxyz", 900, 60)
    near = clean[3][1].rsplit(" ", 1)[0] + " other"
    docs = [*clean, (40, clean[0][1]), (41, clean[0][1]), (42, near), (43, speech("abcdeuvwxyz", 43, 70) + " " + passage), (44, passage + " " + speech("abcdeuvwxyz", 44, 70)),
            (45, "12 34"), (46, None), (47, "")]
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    tokens = {r.doc_id: r.doc_tokens for r in out}
    assert set(tokens) == {i for i, _ in clean} - {0} | {41, 43, 44}  # of equal texts the largest id, of near ones the least
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    left = {i: t for i, t in docs if i in tokens} | {43: speech("abcdeuvwxyz", 43, 70), 44: speech("abcdeuvwxyz", 44, 70)}
    assert tokens == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert sum(r.length for r in out) == sum(tokens.values())
