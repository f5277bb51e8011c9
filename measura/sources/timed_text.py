"""Parsers of timed and plain lyric texts: one row in, one row for each cue or line out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions.text import clock_seconds, plain_text

STAMP = r"\[(\d{1,3}:\d{1,2}(?:\.\d{1,3})?)\]"
WORD_STAMP = r"<(\d{1,3}:\d{1,2}(?:\.\d{1,3})?)>"


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_ix, line) of every line; a null text has none."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_ix", "line"))


def looks_like_lrc(text: Column) -> Column:
    """At least two lines that aren't blank, two of them stamped, and half of all."""
    some = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    stamped = F.size(F.filter(some, lambda x: x.rlike(r"^\s*\[\d{1,3}:\d{1,2}(?:\.\d{1,3})?\]")))
    return (F.size(some) >= 2) & (stamped >= 2) & (stamped * 2 >= F.size(some))


def parse_lrc(df: DataFrame, key: str, text: str, duration: float = 600.0) -> DataFrame:
    """(key, start, end, text): a cue for each stamp; it ends where the next begins, the last after five seconds."""
    rows = lines_of(df, key, text).withColumn("stamps", F.regexp_extract_all("line", F.lit(STAMP), F.lit(1)))
    rows = rows.withColumn("body", F.regexp_replace("line", STAMP, "")).withColumn("text", plain_text(F.regexp_replace("body", WORD_STAMP, ""))).where("size(stamps) > 0 AND text <> ''")
    cues = rows.select(key, "line_ix", "text", F.posexplode("stamps").alias("stamp_ix", "stamp")).withColumn("start", clock_seconds(F.col("stamp")))
    w = W.partitionBy(key).orderBy("start", "text", "line_ix", "stamp_ix")
    end = F.coalesce(F.lead("start").over(w), F.least(F.lit(float(duration)), F.col("start") + 5))
    return cues.select(key, "start", F.greatest(F.col("start") + F.lit(0.05), end).alias("end"), "text")


def parse_lrc_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_ix, word_ix, start, word) of the word stamps inside lines."""
    parts = lines_of(df, key, text).where(F.col("line").rlike(WORD_STAMP))
    pieces = F.split("line", WORD_STAMP)
    stamps, words = F.regexp_extract_all("line", F.lit(WORD_STAMP), F.lit(1)), F.slice(pieces, F.lit(2), F.size(pieces))
    z = parts.select(key, "line_ix", F.posexplode(F.arrays_zip(stamps.alias("stamp"), words.alias("word"))).alias("word_ix", "z"))
    return z.select(key, "line_ix", "word_ix", clock_seconds(F.col("z.stamp")).alias("start"), plain_text(F.col("z.word")).alias("word")).where("word <> ''")


def parse_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_ix, start, end, text) of WebVTT and SubRip blocks: a time line, then the words, joined by spaces."""
    blocks = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n[ \t]*\r?\n")).alias("block_ix", "block")).where(F.col("block").contains("-->"))
    clock = r"((?:\d{1,3}:)?\d{1,3}:\d{1,2}[.,]\d{1,3})"
    times = lambda g: clock_seconds(F.regexp_extract("block", clock + r"[ \t]+-->[ \t]+" + clock, g))
    body = plain_text(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*(?:\n|$)", ""))
    return blocks.select(key, "block_ix", times(1).alias("start"), times(2).alias("end"), body.alias("text")).where("start IS NOT NULL AND end IS NOT NULL AND text <> ''")


def plain_cues(df: DataFrame, key: str, text: str, duration: Column) -> DataFrame:
    """(key, line_ix, start, end, text): the lines that aren't blank share the duration evenly."""
    rows = lines_of(df.withColumn("__d", duration), key, text).withColumn("text", plain_text(F.col("line"))).where("text <> ''")
    rows = rows.join(df.select(key, duration.alias("__d")), key)
    w = W.partitionBy(key)
    i, n = F.row_number().over(w.orderBy("line_ix")) - 1, F.count("*").over(w)
    return rows.withColumns({"i": i, "n": n}).select(key, F.col("i").cast("long").alias("line_ix"), F.round(F.col("i") * F.col("__d") / F.col("n"), 9).alias("start"), F.round(F.least(F.col("__d"), (F.col("i") + 1) * F.col("__d") / F.col("n")), 9).alias("end"), "text")


CUES_JSON = "array<struct<start double, end double, text string>>"


def json_cues(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cue_ix, start, end, text, reject) of JSON arrays of cues.

    A document is taken whole or not at all: if its JSON can't be read, or any cue lacks a finite 0 <= start <= end
    or its text, it gives one row with the reason in ``reject``.
    """
    read = df.select(key, F.from_json(text, CUES_JSON, {"mode": "PERMISSIVE"}).alias("cues"), F.col(text).alias("__raw"))
    good = F.forall("cues", lambda c: F.coalesce(c["text"].isNotNull() & (c["start"] >= 0) & (c["end"] >= c["start"]) & (c["end"] < float("inf")), F.lit(False)))
    reason = F.when(F.col("cues").isNull(), "unreadable").when(F.size("cues") == 0, "empty").when(~good, "malformed cue")
    marked = read.withColumn("reject", reason)
    bad = marked.where("reject IS NOT NULL").select(key, F.lit(None).cast("int").alias("cue_ix"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("text"), "reject")
    fine = marked.where("reject IS NULL").select(key, F.posexplode("cues").alias("cue_ix", "c")).select(key, "cue_ix", "c.start", "c.end", "c.text", F.lit(None).cast("string").alias("reject"))
    return fine.unionByName(bad)
