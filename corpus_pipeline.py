"""A corpus cleaned in stages; each stage works on all that its predecessor kept, and its decisions take effect.

All stages but the last return the columns of ``documents``; the last returns the packed pieces. A stage's table is written to the
shared folder before the next one reads it, so an executor that is lost costs at most a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, keyed, one_of_each, small
from tributary.llm.exact import drop_exact
from tributary.llm.language import UNKNOWN, held_out, identified
from tributary.llm.minhash import near_duplicates
from tributary.llm.packing import packed
from tributary.llm.queries import TOKENIZER
from tributary.llm.substring import without_repeats

#: A document stays if its words are at least this certain, on average, of whatever language each of them is.
LEAST_CERTAINTY = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a text without letters goes, and one whose words no language fits better than the others. Text in
    several languages stays. Null and empty texts go; repeated rows and null ids are judged alike; an empty table stays empty."""
    found = identified(docs, ~held_out())
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("certainty") >= LEAST_CERTAINTY)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the largest doc_id (of null ids or repeated rows one). Null texts are empty ones."""
    return drop_exact(docs, Scratch(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) one row, with the smallest doc_id; of repeated rows one."""
    scratch = Scratch(spark)
    found = near_duplicates(docs, scratch, shingle=5, threshold=80, carry=["doc_id"])
    counted = found.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.bool_or("first").alias("first"))
    odd = scratch.save(counted.where("n > 1 OR NOT first"), "odd")
    scratch.keep("odd")
    rows, odd = keyed(docs, "text", ["doc_id"]), small(odd)
    alone = rows.join(odd, ["r1", "r2"], "left_anti").select("row")
    return alone.union(one_of_each(rows.join(odd.where("first"), ["r1", "r2"]), "r1", "r2")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated 35-word windows, their other words joined by one space; texts without any stay as they are, null ones
    become empty. Rows with null ids are cleaned like others; an empty table stays empty."""
    found = without_repeats(docs, Scratch(spark), carry=[c for c in docs.columns if c != "text"], as_is=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; a null or empty text is one token, and so is its piece. Repeated rows
    and null ids are packed like others; an empty table gives no pieces."""
    return packed(docs, TOKENIZER, carry=["doc_id"]).select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", packing)]

#: A trained model, connected components and token windows have no SQL; tests run the three dedup stages on small hand-made tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
