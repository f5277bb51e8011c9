"""Operators over note events: restart merge, onset groups, polyphony, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions.music import TUNINGS

RESTART_GAP, ONSET_WINDOW, FLOOR, POLYPHONY, MAX_FRET = 0.15, 0.09, 0.5, 4, 20


def restart_merge(notes: DataFrame, key: str, gap: float = RESTART_GAP) -> DataFrame:
    """Join notes of one pitch that restart within ``gap`` of the running end (inclusive).

    Result: (key, pitch, start, end, confidence, merged): earliest start, latest end, best confidence, count.
    """
    w = W.partitionBy(key, "pitch").orderBy("start", "end", F.desc("confidence"), "note_id")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = notes.withColumn("fresh", F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(key, "pitch", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.count("*").alias("merged")).drop("island")


def onset_groups(notes: DataFrame, key: str, window: float = ONSET_WINDOW) -> DataFrame:
    """``notes`` with ``anchor``: the start of the first note of its group.

    A note joins while its start is within ``window`` of the *first* start of the group, which no
    lag can express. A distance above ``window`` to the note before always opens a group, so
    stretches between such distances are independent and only within them the starts are folded.
    """
    w = W.partitionBy(key).orderBy("start", "end", "pitch", "confidence")
    apart = F.coalesce((F.col("start") - F.lag("start").over(w) > window).cast("int"), F.lit(1))
    parts = notes.withColumn("__cut", apart).withColumn("__part", F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    starts = parts.groupBy(key, "__part").agg(F.array_sort(F.collect_set("start")).alias("__s"))
    fold = F.aggregate("__s", F.array().cast("array<double>"), lambda acc, s: F.when((F.size(acc) > 0) & (s - F.element_at(acc, -1) <= window), acc).otherwise(F.array_append(acc, s)))
    anchors = starts.select(key, "__part", fold.alias("__a"))
    joined = parts.join(anchors, [key, "__part"])
    return joined.withColumn("anchor", F.array_max(F.filter("__a", lambda a: a <= F.col("start")))).drop("__cut", "__part", "__a")


def strongest(groups: DataFrame, keys: Sequence[str], most: int = POLYPHONY) -> DataFrame:
    """The strongest note of each pitch of a group, then the ``most`` strongest pitches (higher pitch first on a tie)."""
    per_pitch = W.partitionBy(*keys, "pitch").orderBy(F.desc("confidence"), "start", "end")
    top = W.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("pitch"))
    one = groups.withColumn("__r", F.row_number().over(per_pitch)).where("__r = 1")
    return one.withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= most).drop("__r")


def playable(pitch: Column, tuning: Sequence[int] = TUNINGS["standard"], max_fret: int = MAX_FRET) -> Column:
    """Whether some string reaches the pitch."""
    return F.exists(F.array(*(F.lit(t) for t in tuning)), lambda t: pitch.between(t, t + max_fret))


def positions(notes: DataFrame, tuning: Sequence[int] = TUNINGS["standard"], max_fret: int = MAX_FRET) -> DataFrame:
    """``notes`` with one row for each (string, fret) that gives the pitch; string 0 is the lowest."""
    strings = F.array(*(F.struct(F.lit(i).alias("string"), F.lit(t).alias("open")) for i, t in enumerate(tuning)))
    out = notes.withColumn("__s", F.explode(strings)).withColumn("fret", F.col("pitch") - F.col("__s.open"))
    return out.where(F.col("fret").between(0, max_fret)).withColumn("string", F.col("__s.string")).drop("__s")
