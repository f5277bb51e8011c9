"""Problems 1 and 2: garbled text, and text that looks the same in other characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm.encoding import garbled_fields
from measura.llm.unify import unify
from measura.session import cut, table

KEYS = ["rec_kind", "rec_id", "field_name"]


def _field(df: DataFrame, kind: str, key: str, field: str) -> DataFrame:
    return df.select(F.lit(kind).alias("rec_kind"), F.col(key).alias("rec_id"), F.lit(field).alias("field_name"), F.col(field).alias("text"))


def media_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "media_metadata")
    return _field(media, "media", "song_id", "title").unionByName(_field(media, "media", "song_id", "artist"))


def repairable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of problem 1 as (rec_kind, rec_id, field_name, text)."""
    return media_fields(spark, sf_dir).unionByName(_field(table(spark, sf_dir, "embedded_lyrics"), "lyrics", "lyrics_id", "text"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each garbled field with its original text where it can be had (else as far as it can)."""
    return garbled_fields(repairable(spark, sf_dir), KEYS, "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select(*KEYS)


def garbled_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(KEYS, restored) of the titles and artists that problem 1 lists; lyrics give it votes and words, so they are read with them."""
    return cut(p1_restored(spark, sf_dir).where("rec_kind = 'media'").select(*KEYS, "restored"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field that isn't in the consistent form, with its text in that form; garbled fields are left to problem 1."""
    fields = media_fields(spark, sf_dir).unionByName(_field(table(spark, sf_dir, "raw_cues"), "cue", "cue_id", "text"))
    return unify(fields, KEYS, "text").join(garbled_media(spark, sf_dir).select(*KEYS), KEYS, "left_anti")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_unified(spark, sf_dir).select(*KEYS)


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p2_unified": p2_unified}
ORACLES: dict[str, str] = {}
