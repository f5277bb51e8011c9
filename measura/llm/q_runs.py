"""Problem 5: lines that the decoder repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm.runs import collapse_runs
from measura.session import table


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of one line in the cues of an attempt, with its count and duration."""
    runs = collapse_runs(table(spark, sf_dir, "raw_cues"), "attempt_id", "start_s", "cue_id", "text", "end_s")
    return runs.select("attempt_id", F.col("first_key").alias("first_cue_id"), F.col("last_key").alias("last_cue_id"), "n", F.col("start").alias("start_s"), (F.col("end") - F.col("start")).alias("duration_s"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_runs(spark, sf_dir).select("attempt_id", "first_cue_id", "last_cue_id")


QUERIES = {"p5_found": p5_found, "p5_runs": p5_runs}
ORACLES: dict[str, str] = {}
