"""The tables of the data folder as the domain's clean inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.session import table


def finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def load_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid note events: finite 0 <= start < end, pitch in 0..127, confidence in 0..1 (null reads as 1); each note once."""
    t = table(spark, sf_dir, "notes")
    conf = F.coalesce("confidence", F.lit(1.0))
    good = finite("start_s") & finite("end_s") & (F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s")) & F.col("pitch").between(0, 127) & ~F.isnan(conf) & conf.between(0.0, 1.0)
    return t.where(good).select("note_id", "run_id", "song_id", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "pitch", conf.alias("confidence")).dropDuplicates(["note_id"])


def load_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder cues with finite 0 <= start < end and words; each cue once."""
    t = table(spark, sf_dir, "raw_cues")
    good = finite("start_s") & finite("end_s") & (F.col("start_s") >= 0) & (F.col("end_s") > F.col("start_s")) & (F.trim("text") != "")
    return t.where(good).select("cue_id", "attempt_id", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "avg_logprob").dropDuplicates(["cue_id"])


def load_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words with a finite start and an end not before it; each word once."""
    t = table(spark, sf_dir, "lyric_words")
    good = finite("start_s") & finite("end_s") & (F.col("start_s") >= 0) & (F.col("end_s") >= F.col("start_s"))
    return t.where(good).select("word_id", "cue_id", "attempt_id", "word_ix", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text").dropDuplicates(["word_id"])


#: The same inputs for the oracles.
NOTES_SQL = """notes_c AS (SELECT DISTINCT note_id, run_id, song_id, start_s AS start, end_s AS "end", pitch, coalesce(confidence, 1.0::DOUBLE) AS confidence FROM notes
 WHERE isfinite(start_s) AND isfinite(end_s) AND start_s >= 0 AND start_s < end_s AND pitch BETWEEN 0 AND 127 AND NOT isnan(coalesce(confidence, 1.0::DOUBLE)) AND coalesce(confidence, 1.0::DOUBLE) BETWEEN 0 AND 1)"""
CUES_SQL = """cues_c AS (SELECT DISTINCT cue_id, attempt_id, start_s AS start, end_s AS "end", text, avg_logprob FROM raw_cues
 WHERE isfinite(start_s) AND isfinite(end_s) AND start_s >= 0 AND end_s > start_s AND trim(text) <> '')"""
WORDS_SQL = """words_c AS (SELECT DISTINCT word_id, cue_id, attempt_id, word_ix, start_s AS start, end_s AS "end", text FROM lyric_words
 WHERE isfinite(start_s) AND isfinite(end_s) AND start_s >= 0 AND end_s >= start_s)"""
