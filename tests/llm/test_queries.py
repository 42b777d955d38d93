"""The registered queries of the subpackage over whole small tables with nulls, repeated rows and columns of any name."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from llm import brute
from llm.test_near_and_substring import corpus
from tributary.llm import language, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_warc", "op7_exact_dedup"])
def test_like_their_sql(spark, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), connect(SF).execute(entry.oracle_sql()[name]).df()
    if "refers_to" in got:  # pandas has two kinds of missing numbers
        got, want = (t.assign(refers_to=t.refers_to.fillna(-1).astype("int64")) for t in (got, want))
    assert difference(got, want) is None and len(got)


@pytest.fixture(scope="module")
def pairs():
    return [(100 + i, t) for i, t in corpus(9, copies=15)]


@pytest.fixture(scope="module")
def folder(spark, pairs, tmp_path_factory):
    """The corpus with a repeated row, rows without an id, and columns that clash with names the operators use."""
    out = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*pairs, pairs[4], (None, None), (None, pairs[0][1])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.withColumns({c: F.lit(1) for c in ["row", "r1", "c", "ids", "start", "length", "score", "lang_pred", "kept"]}).write.parquet(f"{out}/documents.parquet")
    return str(out)


def found(df):
    return sorted(map(tuple, df.where("doc_id IS NOT NULL").distinct().collect()))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, folder, pairs):
    want = brute.near_components(pairs, 4, 80)
    assert found(queries.op1_minhash_dedup(spark, folder)) == sorted((i, n, c, i == c) for i, (n, c) in want.items())
    assert queries.op1_minhash_dedup(spark, folder).count() == len(pairs) + 3


def test_op10(spark, folder, pairs):
    """The repeated row and the one without an id repeat their words too."""
    whole = [*((str(i), t) for i, t in pairs), ("again", pairs[4][1]), ("lone", pairs[0][1])]
    want = brute.kept_words(whole, 35)
    assert found(queries.op10_substring_dedup(spark, folder)) == sorted((i, n, g, sha(k)) for i, (n, g, k) in ((i, want[str(i)]) for i, _ in pairs))


def test_op3_and_op5(spark, folder, pairs):
    """Ids as the library's; pieces hold each id once, sequences have no gaps and little padding."""
    library = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    library.no_truncation()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in pairs}
    decode = {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}
    assert found(queries.op3_bpe_round_trip(spark, folder)) == sorted((i, len(x), sha(",".join(map(str, x))), sha(decode[i])) for i, x in ids.items())
    pieces = queries.op5_packing(spark, folder).collect()
    sequences, own = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        own.setdefault(p.doc_id, []).append(p)
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1] and sum(n for _, n in parts) <= 1024
    for i, x in ids.items():
        whole = np.array([*x, 0], "<u4")
        copies = 1 + (i == pairs[4][0])
        assert sum(p.length for p in own[i]) == copies * len(whole)
        assert all(p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(whole[p.start:p.start + p.length].tobytes()) for p in own[i])


def test_op8(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 8)).astype(np.float32))] + [(401, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (5, [1.0] * 8)]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for x in queries.op8_nearest_vectors(spark, str(tmp_path)).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    whole = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and np.isfinite(v).all() and any(v)]
    assert set(got) == {i for i, _ in whole if i % 20 == 0}
    hits = 0
    for q, listed in got.items():
        v = next(x for i, x in whole if i == q)
        best = sorted((-float(sum(a * b for a, b in zip(v, x, strict=True))), i) for i, x in whole if i != q)[:20]
        assert [n for n, *_ in sorted(listed)] == list(range(1, 21))
        hits += len({i for _, i, _ in listed} & {i for _, i in best})
    assert hits >= 0.9 * 20 * len(got)


def test_op9(spark, tmp_path):
    """Held-out documents by checksum, languages from letters, junk and nulls undetermined, the same result without the given language."""
    r = random.Random(1)
    say = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n))
    rows = [(i, say("abcdef" if i % 2 else "uvwxyz", 40), "aa" if i % 2 else "zz") for i in range(120)] + [(500, None, "aa"), (501, "12 !! ²", "zz"), (None, say("abcdef", 30), "zz")]
    spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op9_language(spark, str(tmp_path)).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows[:120])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows[:-1]) and got[None].held_out is True and got[None].lang_pred == "aa"
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501)] == [("und", 0.0)] * 2


def test_forward_backward_like_all_label_sequences():
    """Marginals of texts of different lengths, from the weights of every sequence of labels."""
    r = np.random.default_rng(4)
    crf = language.Crf(["a", "b", "c"], {}, np.zeros((0, 3)), r.normal(size=(3, 3)).astype(np.float32))
    counts = np.array([3, 1, 0, 5, 3])
    crf.table = r.normal(size=(int(counts.sum()), 3)).astype(np.float32)
    got = crf.marginals(np.arange(len(crf.table)), counts)
    for n, end in zip(counts, np.cumsum(counts), strict=True):
        e = crf.table[end - n:end].astype(float)
        total = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(e[k, x] for k, x in enumerate(labels)) + sum(crf.moves[x, y] for x, y in itertools.pairwise(labels)))
            for k, x in enumerate(labels):
                total[k, x] += w
        assert np.allclose(got[end - n:end], total / total.sum(1, keepdims=True), atol=1e-4)


def test_very_long_texts(spark, documents, scratch):
    """A text of 64 MB goes through near and substring deduplication beside ordinary ones."""
    words = F.expr("concat_ws(' ', transform(sequence(1, 9000000), i -> cast(i as string)))")
    long = spark.range(1).select(words.alias("text")).withColumn("doc_id", F.lit(1).cast("long"))
    assert long.select(F.length("text")).first()[0] > 64 << 20
    docs = long.select("doc_id", "text").union(documents([(2, " ".join(f"x{i}" for i in range(90))), (3, " ".join(map(str, range(5000, 5060))))]).select("doc_id", "text"))
    near = queries.near_duplicates(docs, scratch, carry=["doc_id"]).select("id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, near)) == [(1, 8_999_996, 1), (2, 86, 2), (3, 56, 3)]
    cut = queries.without_repeats(docs, scratch, carry=["doc_id"]).select("row.doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, cut)) == [(1, 9_000_000, 60), (2, 90, 0), (3, 60, 60)]
