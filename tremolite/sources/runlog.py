"""Append-only tables of inversion runs and their JSON-lines companions."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .manifest import append_once, read_committed

TIMING = "iter long, elapsed_s double"
QUALITY = "iter long, avg_abs_pct_dev double"


class RunLog:
    """Writes each cycle of a run below one folder, partitioned by run and iteration.

    Every table is an append with a manifest: a cycle that is logged again, after a failure or a restart, replaces its rows.
    """

    KEYS = ["run_id", "iter"]

    def __init__(self, spark: SparkSession, folder: str, run_id: str, truth: DataFrame | None = None):
        self.spark, self.folder, self.run_id, self.truth = spark, folder, run_id, truth
        self._since = time.monotonic()

    def _append(self, df: DataFrame, table: str, iteration: int) -> None:
        named = df.select("*", F.lit(self.run_id).alias("run_id"), F.lit(iteration).alias("iter"))
        append_once(named, f"{self.folder}/{table}", self.KEYS)

    def meta(self, params: dict, grid: dict) -> None:
        row = self.spark.range(1).select(
            F.lit(self.run_id).alias("run_id"), F.lit(json.dumps(params)).alias("params"), F.lit(json.dumps(grid)).alias("grid_info")
        )
        append_once(row, f"{self.folder}/meta", ["run_id"])

    def cycle(self, iteration: int, model: DataFrame, step) -> None:
        """Model before the step, correction, weights, residuals, ray sums, timing and quality."""
        self._append(model, "model", iteration)
        self._append(step.correction, "delta_s", iteration)
        self._append(step.weights, "weights", iteration)
        self._append(step.residuals, "residuals", iteration)
        self._append(step.sums, "ray_sums", iteration)
        now = time.monotonic()
        elapsed, self._since = now - self._since, now
        self._append(self.spark.range(1).select(F.lit(elapsed).alias("elapsed_s")), "timing", iteration)
        if self.truth is not None:
            from ..operators.measures import model_deviation

            self._append(model_deviation(model, self.truth, [], ["i", "j", "k"]), "quality", iteration)

    def read(self, table: str) -> DataFrame:
        """Valid rows of this run."""
        keys = ["run_id"] if table == "meta" else self.KEYS
        return read_committed(self.spark, f"{self.folder}/{table}", keys).filter(F.col("run_id") == self.run_id)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("append").json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: str, key: str = "iter") -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and the number of lines that could not be read."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    good = parsed.filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull()).select("_r.*").drop("_bad")
    dropped = parsed.filter(F.col("_r").isNull() | F.col("_r._bad").isNotNull()).agg(F.count(F.lit(1)).alias("dropped"))
    return good, dropped
