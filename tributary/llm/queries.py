"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.ann import nearest
from tributary.llm.bpe import encoded
from tributary.llm.centroid import clustered, with_inertia
from tributary.llm.common import Scratch
from tributary.llm.exact import exact_groups
from tributary.llm.language import held_out, identified
from tributary.llm.lines import without_shared_lines
from tributary.llm.minhash import near_duplicates
from tributary.llm.packing import packed
from tributary.llm.periodic import periodic_runs
from tributary.llm.substring import without_repeats
from tributary.llm.toxicity import toxicity
from tributary.llm.url_filter import RULE_DDL, host_rule, judged
from tributary.llm.warc import archived


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Host, path and action of the rules that the query applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over four-word shingles at a similarity of 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), shingle=4, threshold=80, carry=["doc_id"])
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    rules = spark.createDataFrame([host_rule(*r) for r in RULES], RULE_DDL)
    return judged(table(spark, sf_dir, "pages"), rules, Scratch(spark))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    found = encoded(table(spark, sf_dir, "documents"), TOKENIZER, carry=["doc_id"], decoded=True)
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of low quality and then of toxicity, for every document."""
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), categories, carry=["doc_id"])
    return found.select("row.doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"), TOKENIZER, carry=["doc_id"]).select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, from archives written and read back."""
    found = archived(table(spark, sf_dir, "pages"), Scratch(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document, by the extendible-hash index."""
    return exact_groups(table(spark, sf_dir, "documents"), Scratch(spark))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), Scratch(spark), F.col("vec_id") % 20 == 0, k=20)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from two thirds of them."""
    found = identified(table(spark, sf_dir, "documents"), ~held_out(), carry=["doc_id"])
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once repeated 35-word windows are gone."""
    found = without_repeats(table(spark, sf_dir, "documents"), Scratch(spark), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every document once those that ten documents share are gone."""
    found = without_shared_lines(table(spark, sf_dir, "documents"), Scratch(spark), min_docs=10, min_chars=1, carry=["doc_id"])
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of documents whose h = crc32(doc_id) divides by ten, every word i from a on becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    few = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    few = few.select("doc_id", "text", "w", "g", F.size("w").alias("n"), F.when(F.size("w") > 0, (F.col("g") % F.size("w")).cast("int")).alias("a"))
    rest = F.col("n") - F.col("a")
    p = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil(rest / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, p), times)), F.lit(1), rest)
    return few.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of words that repeat with a period, and what is left of every document without the repeats."""
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")), carry=["doc_id"])
    more = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), more)
    found = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds from eight centroids."""
    scratch = Scratch(spark)
    found, centroids = clustered(table(spark, sf_dir, "embeddings"), scratch)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return with_inertia(found, scratch).withColumn("centroid_sha256", F.get(F.array(*map(F.lit, digests or [""])), F.col("cluster")))


QUERIES = [op1_minhash_dedup, op2_url_filter, op3_bpe_round_trip, op4_toxicity, op5_packing, op6_warc, op7_exact_dedup, op8_nearest_vectors,
           op9_language, op10_substring_dedup, op11_line_dedup,
           op12_periodic_runs, op13_centroid_clusters]
