"""Problem 6: the act that a typed artist means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.llm.names import link_names
from measura.llm.q_repair import garbled_media
from measura.session import table


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song_id, artist, artist_id, cost) of each song whose artist means a registered act; cost 0 is the registered spelling."""
    media = table(spark, sf_dir, "media_metadata").select("song_id", "artist").where("artist <> ''").dropDuplicates(["song_id"])
    mended = garbled_media(spark, sf_dir).where("field_name = 'artist'").select(F.col("rec_id").alias("song_id"), "restored")
    media = media.join(mended, "song_id", "left").withColumn("meant", F.coalesce("restored", "artist"))
    links = link_names(media, "meant", table(spark, sf_dir, "artist_registry"), "artist_id", "act_name")
    return media.join(links, media["meant"] == links["original"]).select("song_id", "artist", "artist_id", "cost")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_links(spark, sf_dir).where("cost > 0").select("song_id", "artist_id")


QUERIES = {"p6_found": p6_found, "p6_links": p6_links}
ORACLES: dict[str, str] = {}
