"""Exact duplicates by an extendible-hash index in the shared folder. DataFrame functions only.

The directory maps the leading bits of a key to a bucket, so a bucket is a range of keys; it doubles until no bucket holds too many. Each
bucket belongs to one task. That task sorts its entries by key and text and walks along the chain of each key, comparing whole
texts. Texts reach it pre-aggregated, a few rows for each distinct one, however many rows share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, one_of_each, small

#: Distinct keys that a bucket of the index holds before it splits. Rows of one text that reach its bucket, at most.
CAPACITY, SALTS = 256, 8
#: Longest prefix of a 64-bit key.
KEY_BITS = 64


def slot(key, depth: int):
    """The directory slot of a key: its top ``depth`` bits."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, KEY_BITS - max(depth, 1)), int(not depth))


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Slots of the directory (slot, global_depth, local_depth, bucket) over ``entries`` (key: distinct longs).

    The directory doubles until every slot holds at most ``capacity`` keys; a slot's local depth is the shortest prefix whose
    bucket still fits, so slots that share a prefix share a bucket. Slots are counted in one pass per global depth, and
    the directory is a table: it is never gathered on the driver.
    """
    total = entries.count()
    depth = max(0, -(-total // capacity) - 1).bit_length()
    while True:
        slots = entries.groupBy(slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("keys"))
        most = slots.agg(F.max("keys")).first()[0] or 0
        if most <= capacity or depth >= KEY_BITS - 1:
            break
        depth += max(1, (-(-most // capacity) - 1).bit_length())
        depth = min(depth, KEY_BITS - 1)
    out = slots.withColumn("local_depth", F.lit(depth)).withColumn("bucket", F.col("slot"))
    for d in range(depth - 1, -1, -1):  # merge what a shorter prefix still holds
        up = F.shiftrightunsigned("slot", depth - d)
        fits = slots.groupBy(up.alias("parent")).agg(F.sum("keys").alias("together")).where(F.col("together") <= capacity)
        if not fits.limit(1).count():
            break
        out = out.join(fits, F.shiftrightunsigned(out.slot, depth - d) == fits.parent, "left").select(
            "slot", "keys", F.when(F.col("parent").isNull(), F.col("local_depth")).otherwise(d).alias("local_depth"),
            F.coalesce("parent", "bucket").alias("bucket"))
    return out.select("slot", F.lit(depth).alias("global_depth"), "local_depth", "bucket", "keys")


def owned(entries: DataFrame) -> DataFrame:
    """The groups of equal texts of ``entries`` (bucket, key, text, id): bucket, key, text, keep_id, group_size.

    A text's rows are added up map-side, then to at most SALTS rows, then its bucket's task meets them: entries of a key form a
    chain in the order of their texts, and one that differs from its predecessor begins a new group.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    few = entries.groupBy("bucket", "key", "text", salt).agg(F.max("id").alias("top"), F.count("*").alias("n"))
    chain = Window.partitionBy("bucket", "key").orderBy("text", "salt")
    begins = (F.lag("text").over(chain).isNull() | (F.lag("text").over(chain) != F.col("text"))).cast("int")
    links = few.repartition("bucket").withColumn("begins", begins).withColumn("link", F.sum("begins").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    return links.groupBy("bucket", "key", "link").agg(F.min("text").alias("text"), F.max("top").alias("keep_id"), F.sum("n").alias("group_size")).drop("link")


def grouped(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", key=None,
            capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Columns row (all columns of ``docs``), id, keep_id, group_size and text of every row: first the rows whose key occurs once, then
    the others; see ``exact_groups``.

    Keys are counted with map-side sums and only keys that occur twice enter the index, each in the bucket of its directory slot.
    The text of a row moves only if its key is in the index. Groups are written by their buckets before rows are joined with
    them, so that adaptive execution may split the rows of a frequent text.
    """
    key = key or F.xxhash64
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", key(F.col("text")))
    repeated = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    slots = scratch.save(directory(repeated, capacity), "directory")
    depth = slots.agg(F.max("global_depth")).first()[0] or 0
    index = repeated.withColumn("slot", slot(F.col("key"), depth)).join(small(slots), "slot").select("key", "bucket")
    index = small(scratch.save(index, "index"))
    chained = rows.join(index, "key")
    same = ["bucket", "key", "text"]
    owners = scratch.save(owned(chained), "owners")
    found = chained.join(owners, same).select("row", "id", "keep_id", "group_size", "text")
    single = rows.join(index, "key", "left_anti").select("row", "id", F.col("id").alias("keep_id"),
                                                         F.lit(1).cast("long").alias("group_size"), "text")
    return single, found


def exact_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", key=None,
                 capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts have the same bytes; a null text is empty. Of equal rows the largest id stays. ``key``
    maps the text column to a 64-bit key (default: xxhash64); texts that only share a key are told apart. Repeated rows (same
    id, same text) are all kept or all dropped; a null id wins only where all ids of a group are null; an empty table gives an
    empty result; other columns of ``docs``, whatever their names, are ignored.
    """
    single, found = grouped(docs.select(id_col, text_col), scratch, id_col, text_col, key, capacity)
    return single.unionByName(found).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.sha2("text", 256).alias("text_sha256"))


def drop_exact(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, that with the largest id; all columns stay as they are.

    Rows that share text and id, or texts whose ids are all null, leave one row too (see ``one_of_each``).
    """
    single, found = grouped(docs, scratch, id_col, text_col)
    kept = one_of_each(found.where(F.col("id").eqNullSafe(F.col("keep_id"))), "text")
    return single.select("row").union(kept).select("row.*")
