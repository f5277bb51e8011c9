"""Files of a project: listed with their sizes, taken in within a limit, lyric files ranked beside their media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions.text import language_base

# Endings of media files.
MEDIA = ("aac", "flac", "m4a", "mkv", "mp3", "mp4", "ogg", "opus", "wav", "webm")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, stem, ending, bytes, modified) of the files below ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), ending.alias("ending"), "bytes", "modified")


def acquired(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """(path, bytes, sha256, reject) of every file: its digest, or ``too large``. Empty files aren't listed.

    The size is checked before a file is read, so no content above ``max_bytes`` reaches a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    taken = files.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("reject"))
    left = files.where(F.col("length") > max_bytes).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit("too large").alias("reject"))
    return taken.unionByName(left)


def sidecars(files: DataFrame, language: str | None = None) -> DataFrame:
    """(media, lyrics, rank) of the best ``.lrc`` file beside each media file of a ``listing``.

    ``song.lrc`` (0) goes before ``song.<wanted language>.lrc`` (1) and that before another language (2); then the name decides.
    """
    media = files.where(F.col("ending").isin(*MEDIA)).select("folder", F.col("stem").alias("song"), F.col("path").alias("media"))
    lrc = files.where("ending = 'lrc'").select("folder", F.regexp_replace("stem", r"\.[A-Za-z]{2,3}(?:-[A-Za-z0-9]+)?$", "").alias("song"), F.regexp_extract("stem", r"\.([A-Za-z]{2,3}(?:-[A-Za-z0-9]+)?)$", 1).alias("tag"), F.col("path").alias("lyrics"))
    wanted = F.coalesce(language_base(F.col("tag")) == F.lit(language), F.lit(False)) if language else F.lit(False)
    met = media.join(lrc, ["folder", "song"]).withColumn("rank", F.when(F.col("tag") == "", 0).when(wanted, 1).otherwise(2))
    w = W.partitionBy("media").orderBy("rank", "lyrics")
    return met.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("media", "lyrics", "rank")
