"""Run metrics in and out."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.columns import quoted
from tributary.operators.report import experiment_of, latest_runs, parse_run_files
from tributary.sources.shared import hadoop_path

#: Up to so many chosen files are named in the scan, which then opens no others; more are chosen by a join.
LISTED_FILES = 1_000


def append_metrics(rows: DataFrame, path: str) -> None:
    """Add rows to a metrics table; new columns are allowed."""
    rows.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All appended rows; columns a row did not have are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Add rows as JSON lines; rows of one table may have different fields."""
    rows.write.mode("append").json(path)


def write_results(rows: DataFrame, folder: str, name: str, sep: str = "\t") -> None:
    """One delimited file with a header per value of the column ``name``, which is the file's name in ``folder``.

    Each file is written by one task and then moved to its name, so it appears whole or not at all. Other files of the
    folder stay; one with the same name is an error.
    """
    spark, stage = rows.sparkSession, f"{folder}/.{uuid.uuid4().hex}"
    (rows.withColumn("__file", quoted(name)).drop(name).repartition("__file").write.partitionBy("__file")
     .option("header", True).option("sep", sep).csv(stage))
    where, fs = hadoop_path(spark, stage)
    for one in fs.listStatus(where):
        if not one.isDirectory():
            continue
        target, _ = hadoop_path(spark, f"{folder}/{unquote(one.getPath().getName().split('=', 1)[1])}")
        for part in fs.listStatus(one.getPath()):
            if not fs.rename(part.getPath(), target):
                raise FileExistsError(f"cannot write {target}")
    fs.delete(where, True)


def _cells(line: Column, width: int, sep: str) -> Column:
    """The cells of a delimited line as an array of ``width`` texts."""
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(line, ", ".join(f"{n} string" for n in names), {"sep": sep})
    return F.array(*[parsed[n] for n in names])


def file_headers(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """filename and ``names``: the trimmed names in the first line of every file, all files in one scan."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("line"))
    # The first line of a file comes first in the split that starts at 0.
    first = lines.where("start = 0 AND trim(value) <> ''").groupBy("filename").agg(F.min_by("value", "line").alias("header"))
    width = first.agg(F.max(F.size(F.split("header", "\\Q" + sep + "\\E")))).first()[0] or 1
    names = F.transform(_cells(F.col("header"), width, sep), lambda n: F.trim(n))
    return first.select("filename", F.filter(names, lambda n: n.isNotNull()).alias("names"))


def read_results(spark: SparkSession, path: str | list[str], sep: str = "\t", chosen: DataFrame | None = None) -> DataFrame:
    """Delimited files whose headers may differ, in one scan: all columns by name as text, and ``filename``.

    Each file has its own header; a column that a file lacks is null in its rows, of two columns with one name the first
    counts, cells beyond the header are dropped, missing ones are null, and empty files have no rows. Columns come in
    the order of their place in the headers, then by name. ``chosen`` (filename) limits the files.
    """
    headers = file_headers(spark, path, sep)
    file = F.col("_metadata.file_name")
    listed = None
    if chosen is not None:
        chosen = chosen.select("filename").distinct()
        headers = headers.join(chosen, "filename", "left_semi")
        names = [r.filename for r in chosen.limit(LISTED_FILES + 1).collect()]
        listed = file.isin(names) if len(names) <= LISTED_FILES else None
    places = headers.select(F.posexplode("names").alias("place", "name")).groupBy("name").agg(F.min("place").alias("place"))
    columns = [r["name"] for r in places.orderBy("place", "name").collect()]
    width = headers.agg(F.max(F.size("names"))).first()[0] or 1
    cells = [f"c{i}" for i in range(width)]
    rows = (spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", True).option("enforceSchema", True)
            .option("sep", sep).csv(path).select(file.alias("filename"), F.array(*cells).alias("cells")))
    rows = (rows if listed is None else rows.where(listed)).join(headers, "filename")
    place = lambda c: F.array_position("names", F.lit(c)).cast("int")
    return rows.select(*[F.get("cells", F.nullif(place(c), F.lit(0)) - 1).alias(c) for c in columns], "filename")


def latest_results(spark: SparkSession, folder: str, phase: str, sep: str = "\t") -> DataFrame:
    """Rows of the newest metrics file of every (task, experiment) in one phase, and the experiment's name.

    Names are listed without opening the files; one scan then reads the chosen ones.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("filename")))
    chosen = latest_runs(parse_run_files(files), phase)
    if chosen.isEmpty():
        raise ValueError(f"no {phase} results in {folder}")
    return read_results(spark, folder, sep, chosen).withColumn("experiment_name", experiment_of(F.col("name")))
