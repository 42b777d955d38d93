"""Train/test splits that depend on the key alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tributary.functions.columns import digest, quoted

TRAIN, TEST = "train", "test"
# Leading hex digits of the digest that select a prefix bucket.
_PREFIX = 4


@dataclass
class HashSplit:
    """The keys with the smallest digests are the test set: exactly ``max(1, int(n * share))``.

    Fitting finds the digest of the last test key. Applying compares each row's own digest with
    it, so tagging events needs neither a join nor a shuffle and the key list is never gathered.
    """

    keys: list[str]
    seed: int
    cutoff: tuple[str, str] | None
    n_keys: int

    @staticmethod
    def _rank(keys: list[str], seed: int) -> tuple[Column, Column]:
        text = F.concat_ws("|", *[quoted(k).cast("string") for k in keys])
        return digest(text, F.lit(seed)), text

    @classmethod
    def fit(cls, df: DataFrame, keys: list[str], test_share: float = 0.1, seed: int = 42,
            distinct: bool = True) -> "HashSplit":
        """``distinct=False`` when ``keys`` are unique in ``df`` already (row-level splits)."""
        h, text = cls._rank(keys, seed)
        ranked = df.select(*map(quoted, keys))
        ranked = (ranked.distinct() if distinct else ranked).select(h.alias("h"), text.alias("k"))
        counts = (ranked.groupBy(F.substring("h", 1, _PREFIX).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect())
        total = sum(r["n"] for r in counts)
        if not total:
            return cls(list(keys), seed, None, 0)
        left = max(1, int(total * test_share))
        for r in counts:
            if left <= r["n"]:
                break
            left -= r["n"]
        # Only the one bucket that holds the cutoff is ranked: 1/65536 of the keys.
        bucket = ranked.where(F.substring("h", 1, _PREFIX) == r["p"])
        spot = (bucket.withColumn("rn", F.row_number().over(W.partitionBy(F.substring("h", 1, _PREFIX)).orderBy("h", "k")))
                .where(F.col("rn") == left).select("h", "k").first())
        return cls(list(keys), seed, (spot["h"], spot["k"]), total)

    def is_test(self) -> Column:
        if self.cutoff is None:
            return F.lit(False)
        h, text = self._rank(self.keys, self.seed)
        last_h, last_k = self.cutoff
        return (h < F.lit(last_h)) | ((h == F.lit(last_h)) & (text <= F.lit(last_k)))

    def transform(self, df: DataFrame, out: str = "split") -> DataFrame:
        return df.withColumn(out, F.when(self.is_test(), F.lit(TEST)).otherwise(F.lit(TRAIN)))

    def manifest(self, df: DataFrame) -> DataFrame:
        """The distinct keys with their split."""
        return self.transform(df.select(*map(quoted, self.keys)).distinct())


def keep_split(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    return df.where(quoted(split) == F.lit(name))


def in_keys(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*map(quoted, keys)), keys, "left_semi")


def not_in_keys(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*map(quoted, keys)), keys, "left_anti")


def restore_split(df: DataFrame, manifest: DataFrame, keys: list[str], name: str = TEST,
                  dryrun: bool = False) -> DataFrame:
    """Events of the stored split; a dry run keeps every user."""
    return df if dryrun else in_keys(df, keep_split(manifest, name), keys)


def shared_keys(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys of the test side tagged ``both`` or ``test_only``."""
    a, b = train.select(quoted(key)), test.select(quoted(key))
    both = a.intersect(b).withColumn("kind", F.lit("both"))
    return both.unionByName(b.subtract(a).withColumn("kind", F.lit("test_only")))


def spread_by_entity(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """Lay events out by entity for reading entity ranges; a hot entity spans several partitions."""
    cols = [quoted(c) for c in dict.fromkeys([key, *order])]
    spread = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return spread.sortWithinPartitions(*cols)
