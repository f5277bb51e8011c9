"""Sinks: documents of lyrics and tablature as JSON, and the stage ledger as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lyrics(cues: DataFrame, path: str, key: str, source: str, language: str, timing: str, alignment: DataFrame | None = None) -> None:
    """One JSON document for each key: its cues in order, with where they come from.

    ``timing`` is authored, measured or estimated; an alignment report belongs to measured timing only.
    """
    if timing not in ("authored", "measured", "estimated"):
        raise ValueError("timing must be authored, measured or estimated")
    if alignment is not None and timing != "measured":
        raise ValueError("only measured timing has an alignment")
    docs = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("cues"))  # the cues of one document
    docs = docs.withColumns({"source": F.lit(source), "language": F.lit(language), "timing": F.lit(timing)})
    if alignment is not None:
        docs = docs.join(alignment.select(key, F.struct(*[c for c in alignment.columns if c != key]).alias("alignment")), key, "left")
    docs.write.mode("overwrite").json(path)


def write_tab(positions: DataFrame, path: str, key: str, group: str, tuning: tuple[int, ...], max_fret: int, omitted: DataFrame | None = None) -> None:
    """One JSON document for each key: its events with their positions, the tuning, how many events it has and, by ``omitted`` (key, omitted), how many notes it leaves out."""
    events = positions.groupBy(key, group).agg(F.array_sort(F.collect_list(F.struct("string", "fret", "pitch"))).alias("positions"))
    docs = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("start"), "positions"))).alias("events"), F.count("*").alias("n_events"))
    docs = docs.withColumn("tuning", F.struct(F.array(*(F.lit(t) for t in tuning)).alias("midi"), F.lit(max_fret).alias("max_fret")))
    if omitted is not None:
        docs = docs.join(omitted.select(key, F.col("omitted").alias("omitted_notes")), key, "left")
    docs.write.mode("overwrite").json(path)


TAB = "{key} {kind}, events array<struct<start: double, positions: array<struct<string: int, fret: int, pitch: int>>>>, n_events long, tuning struct<midi: array<int>, max_fret: int>"


def read_tabs(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """(key, start, string, fret, pitch, reject) of the tabs that ``write_tab`` wrote: one row a position.

    A tab is taken whole or not at all: one without its key, events or tuning, or with a position that doesn't give back its
    pitch, gives one row with the reason in ``reject``.
    """
    docs = spark.read.schema(TAB.format(key=key, kind=kind)).json(path)
    flat = F.flatten(F.transform("events", lambda e: F.transform(e["positions"], lambda p: F.struct(e["start"].alias("start"), p["string"].alias("string"), p["fret"].alias("fret"), p["pitch"].alias("pitch")))))
    open_ = lambda p: F.try_element_at("tuning.midi", p["string"] + 1)
    sound = F.forall(flat, lambda p: F.coalesce((p["fret"] >= 0) & (p["fret"] <= F.col("tuning.max_fret")) & (open_(p) + p["fret"] == p["pitch"]), F.lit(False)))
    whole = F.col(key).isNotNull() & F.col("events").isNotNull() & F.col("tuning.midi").isNotNull() & (F.size("events") == F.col("n_events"))
    reject = F.when(~F.coalesce(whole, F.lit(False)), "incomplete").when(~sound, "unsound position")
    kept = docs.withColumns({"reject": reject, "p": F.explode_outer(F.when(reject.isNull(), flat))})
    return kept.select(key, "p.start", "p.string", "p.fret", "p.pitch", "reject").where("reject IS NOT NULL OR start IS NOT NULL")


def save_ledger(records: DataFrame, path: str) -> None:
    """The ledger, one partition for each stage; only the partitions that ``records`` holds are replaced."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)
