"""Run records as a stream: the same scoring on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.control import score_runs


def read_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON run records from a folder."""
    return spark.readStream.schema(schema).json(folder)


def scored(runs: DataFrame) -> DataFrame:
    return score_runs(runs)


def by_target(runs: DataFrame, time: str = "finished_at", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Runs and their best score for each target and window of time; late records count up to the delay."""
    s = score_runs(runs).withWatermark(time, delay)
    return s.groupBy(F.window(time, window), "target_field").agg(F.count("*").alias("n_runs"), F.max("scientific_score").alias("best_score"))
