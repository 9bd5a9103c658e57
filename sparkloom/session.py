"""Session defaults that the results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win where none are given."""
    build = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        build = build.master(master)
    if partitions:
        build = build.config("spark.sql.shuffle.partitions", str(partitions))
    return build.getOrCreate()
