"""Event tables in and out: CSV, JSON lines, Parquet, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.columns import quoted

# Rows per written file; sequences are wide, so files stay readable in one task.
MAX_RECORDS_PER_FILE = 2_000_000


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """A delimited file, several of them or a folder; ``.gz`` is read as it is.

    The header is checked against the schema. Gzip cannot be split: spread such input with
    ``repartition`` before heavy work. A member of an archive is read here once unpacked.
    """
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("enforceSchema", False).csv(path))


def read_csv_folders(spark: SparkSession, paths: list[str], schemas: list[T.StructType | str],
                     sep: str = ",") -> DataFrame:
    """Files whose headers differ: union by column name, missing columns become null."""
    tables = [read_csv(spark, p, s, sep) for p, s in zip(paths, schemas, strict=True)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str,
                    partitions: int | None = None) -> DataFrame:
    """JSON lines, gzipped or not; ``partitions`` spreads unsplittable files."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def read_events(spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType | str | None = None,
                sep: str = ",") -> DataFrame:
    """One entry for all scans; the format is a parameter, never guessed from the files."""
    if fmt == "csv":
        return read_csv(spark, path, schema, sep)
    if fmt == "json":
        return read_json_lines(spark, path, schema)
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(*([path] if isinstance(path, str) else path))
    raise ValueError(f"unknown format {fmt}")


def write_sorted(df: DataFrame, path: str, keys: list[str], fmt: str = "csv", sep: str = ",",
                 mode: str = "errorifexists") -> None:
    """Write in key order: range partitions, each sorted, so file order is key order.

    Give the order columns after the index columns: a range can only be cut between different
    keys, so a hot entity is spread by its order.
    """
    cols = [quoted(k) for k in keys]
    writer = df.repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("sep", sep)
    writer.format(fmt).save(path)


def write_sample(df: DataFrame, path: str, order: list[Column], rows: int = 1000,
                 mode: str = "errorifexists") -> None:
    """The first rows in source order as CSV."""
    df.orderBy(*order).limit(rows).write.mode(mode).option("header", True).csv(path)


def write_dataset(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines that must exist and hold at least one row."""
    df = spark.read.schema(schema).json(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def write_split_manifest(manifest: DataFrame, path: str) -> None:
    """(key, split) written once; a second write is an error."""
    manifest.write.mode("errorifexists").parquet(path)


def write_run_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Run settings next to the manifest, one row, written once."""
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()]).write.mode("errorifexists").json(path)


# Masking shares implied by the name of a run from before they were stored.
NAMED_MASKING = [("always", 1.0, 0.0), ("sometimes", 0.25, 0.25)]


def complete_settings(settings: DataFrame, run_name: str) -> DataFrame:
    """Fill in what old settings files lack: ids under their old names and mask shares."""
    for old in ("train", "test"):
        if old in settings.columns and f"{old}_ids" not in settings.columns:
            settings = settings.withColumnRenamed(old, f"{old}_ids")
    mask_all, mask_each = next(((a, e) for word, a, e in NAMED_MASKING if word in run_name), (0.0, 0.0))
    defaults = {"saved_name": run_name, "randomize_order": "randomize" in run_name,
                "mask_all_pct": mask_all, "mask_each_pct": mask_each}
    return settings.withColumns({
        k: F.coalesce(quoted(k), F.lit(v)) if k in settings.columns else F.lit(v) for k, v in defaults.items()})


def with_named_masking(runs: DataFrame, name: str = "name") -> DataFrame:
    """The same defaults for a table of many runs: a stored share wins over the one in the name."""
    n = quoted(name)
    implied = {"mask_all_pct": F.lit(0.0), "mask_each_pct": F.lit(0.0)}
    for word, a, e in reversed(NAMED_MASKING):
        implied["mask_all_pct"] = F.when(n.contains(word), F.lit(a)).otherwise(implied["mask_all_pct"])
        implied["mask_each_pct"] = F.when(n.contains(word), F.lit(e)).otherwise(implied["mask_each_pct"])
    implied["randomize_order"] = n.contains("randomize")
    return runs.withColumns({k: F.coalesce(quoted(k), v) if k in runs.columns else v for k, v in implied.items()})


# Fields of a run's settings file; train and test are the names of the ids in old files.
SETTINGS = ("saved_name string, randomize_order boolean, mask_all_pct double, mask_each_pct double, train_ids array<string>, "
            "test_ids array<string>, train array<string>, test array<string>")


def write_stored_split(manifest: DataFrame, path: str, key: str, ids_per_line: int = 10_000, old_names: bool = False) -> None:
    """Splits of many runs (``run``, key, ``split``, further settings) as JSON settings under ``run=<name>``.

    A line holds some ``ids_per_line`` ids of a run, however many the run has. ``old_names`` writes ``train`` and ``test``.
    """
    settings = [c for c in manifest.columns if c not in ("run", key, "split")]
    sizes = manifest.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / ids_per_line).alias("__lines"))
    line = F.pmod(F.xxhash64(quoted(key)), F.col("__lines"))
    side = lambda name: F.collect_list(F.when(F.col("split") == name, quoted(key).cast("string"))).alias(name if old_names else f"{name}_ids")
    rows = manifest.join(sizes, "run").groupBy("run", line.alias("__line"), *map(quoted, settings)).agg(side("train"), side("test"))
    rows.drop("__line").write.mode("append").partitionBy("run").json(path)


def read_run_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings of all runs under ``path``, old and new files in one scan: run, saved_name, randomize_order, the masking shares, and the
    ids. What a file does not store follows from the run's name; lines of one run hold different ids."""
    raw = spark.read.schema(f"{SETTINGS}, run string").json(path)
    ids = {f"{side}_ids": F.coalesce(f"{side}_ids", side, F.array().cast("array<string>")) for side in ("train", "test")}
    stored = with_named_masking(raw, "run").withColumns({"saved_name": F.coalesce("saved_name", "run"), **ids})
    return stored.select("run", "saved_name", "randomize_order", "mask_all_pct", "mask_each_pct", "train_ids", "test_ids")


def stored_manifest_ids(settings: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Train and test id arrays of settings files as a (key, split) table, beside the columns ``keep``."""
    sides = F.array(F.struct(F.lit("train").alias("split"), F.col("train_ids").alias("ids")),
                    F.struct(F.lit("test").alias("split"), F.col("test_ids").alias("ids")))
    own = [quoted(c) for c in keep]
    return settings.select(*own, F.explode(sides).alias("s")).select(*own, F.explode("s.ids").alias("key"), F.col("s.split").alias("split"))
