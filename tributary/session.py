"""Session settings the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tributary", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; sizes are left to the cluster unless given.

    ``spark.sql.shuffle.partitions`` should be set to two or three times the cores of the
    cluster for large inputs: adaptive execution merges small partitions but never adds any.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
