"""Appends that count once: a manifest names the valid commit of each key, so a repeated append replaces and a broken one stays unseen.

Rows are written first, below their keys and a fresh commit name; only then the manifest gets one row per key. Readers take the newest commit
of each key. Nothing is deleted or rewritten, so readers of an older state are not disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_COMMIT, _AT = "commit", "committed_at"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_rows(df: DataFrame, path: str, keys: list[str]) -> str:
    """Write rows under a fresh commit name and return it; readers don't see them yet."""
    commit = uuid.uuid4().hex
    df.withColumn(_COMMIT, F.lit(commit)).write.mode("append").partitionBy(*keys, _COMMIT).parquet(f"{path}/rows")
    return commit


def publish(spark: SparkSession, path: str, keys: list[str], commit: str) -> None:
    """Make a commit the valid one of every key that it has rows of. One row per key is added to the manifest."""
    known = _stored(spark, f"{path}/manifest")
    newest = known.agg(F.max(_AT)).first()[0] if known is not None else None
    # Keys and commit are partition columns: their values come from folder names.
    own = spark.read.parquet(f"{path}/rows").where(F.col(_COMMIT) == commit).select(*keys, _COMMIT).distinct()
    own.withColumn(_AT, F.lit((newest or 0) + 1).cast("long")).write.mode("append").parquet(f"{path}/manifest")


def append_once(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows of `df` so that they replace what earlier appends stored under the same values of `keys`.

    Keys without rows in `df` keep what they have. One writer per key at a time; failures raise, and leave the earlier state valid.
    """
    publish(df.sparkSession, path, keys, write_rows(df, path, keys))


def read_committed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The valid rows: those of each key's newest commit. Folders of other commits are pruned by the join."""
    valid = spark.read.parquet(f"{path}/manifest").groupBy(*keys).agg(F.max_by(_COMMIT, _AT).alias(_COMMIT))
    return spark.read.parquet(f"{path}/rows").join(valid, [*keys, _COMMIT]).drop(_COMMIT)


def history(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Commits of each key in order: keys, committed_at, commit."""
    return spark.read.parquet(f"{path}/manifest").select(*keys, _AT, _COMMIT)
