"""Programmatic entry points over DataFrames of a user's own."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.config import EngineConfig
from measura.operators import interval_joins as J
from measura.operators import ledger as L
from measura.operators import notes as N
from measura.operators.alignment import align_pairs
from measura.operators.fingering import fingerings
from measura.session import cut


def infer_tab(notes: DataFrame, key: str = "run_id", config: EngineConfig | None = None) -> DataFrame:
    """(key, anchor, string, fret, pitch) of note events (key, note_id, start, end, pitch, confidence).

    Confidence floor, restart merge, onset groups, the strongest playable pitches of a group, then the
    cheapest path of hand shapes.
    """
    c = config or EngineConfig()
    merged = N.restart_merge(notes.where(F.col("confidence") >= c.least_confidence), key)
    groups = N.onset_groups(merged, key).where(N.playable(F.col("pitch"), c.pitches(), c.max_fret))
    return fingerings(N.strongest(groups, [key, "anchor"], c.max_polyphony), key, "anchor", c.pitches(), c.max_fret)


def tab_stats(notes: DataFrame, tab: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, notes, positions, omitted) of a tab inferred from ``notes``: positions and omitted notes add up to the notes."""
    placed = tab.groupBy(key).agg(F.count("*").alias("positions"))
    counted = notes.groupBy(key).agg(F.count("*").alias("notes")).join(placed, key, "left").withColumn("positions", F.coalesce("positions", F.lit(0)))
    return counted.withColumn("omitted", F.col("notes") - F.col("positions"))


def align_words(pairs: DataFrame, keys: Sequence[str], text: str = "text", cues: str = "cues", duration: str | None = None, timed: bool = False) -> DataFrame:
    """Report of aligning each text with the cues of a recording, or with ``timed`` its words with their times."""
    return align_pairs(pairs, keys, text, cues, duration, timed)


def state_at(probes: DataFrame, events: DataFrame, key: str, t: str = "t", start: str = "start", end: str = "end", event_id: str = "event_id") -> DataFrame:
    """``probes`` with the event that sounds at ``t``: the newest that began, if it hasn't ended."""
    hit = J.as_of(probes, events, key, t, start, event_id, [event_id, end])
    return hit.withColumn(event_id, F.when(F.col(t) < F.col(end), F.col(event_id))).drop(end)


def work_left(wanted: DataFrame, ledger: DataFrame, key: str, *inputs: str) -> DataFrame:
    """Stages of ``wanted`` (key, stage, inputs...) that a resumed run still has to do: no done entry has their fingerprint."""
    marked = wanted.withColumn("fingerprint", L.fingerprint("stage", *inputs))
    return L.to_run(marked, ledger, key)


def run_stages(spark: SparkSession, inputs: DataFrame, key: str, stages: Mapping[str, Callable[[DataFrame, str], DataFrame]], folder: str) -> list[str]:
    """Run the stages of a project in order, each for the projects that still need it; the names of those that had work.

    ``inputs`` is (key, fingerprint columns...). A stage gets the keys it has to do and the folder, and its result is written below
    ``folder/stage``, replacing that of these keys. What is done is noted in ``folder/ledger`` with the fingerprint of the inputs, so a run that
    was cut off, or one with new inputs, goes on where it has to; a stage that runs makes all later ones run.
    """
    columns = [c for c in inputs.columns if c != key]
    ledger, ran = os.path.join(folder, "ledger"), []
    names = list(stages)
    for name in names:
        try:
            done = cut(spark.read.parquet(ledger))
        except AnalysisException:  # nothing was done yet
            done = spark.createDataFrame([], f"{key} {dict(inputs.dtypes)[key]}, fingerprint string, status string, stage string")
        wanted = inputs.select(key, F.lit(name).alias("stage"), *columns)
        todo = cut(work_left(wanted, done, key, *columns))
        if todo.isEmpty():
            continue
        ran.append(name)
        where = os.path.join(folder, name)
        new = cut(stages[name](todo.select(key), folder))
        try:
            new = cut(spark.read.parquet(where).join(todo.select(key), key, "left_anti").unionByName(new))
        except AnalysisException:
            pass
        new.write.mode("overwrite").parquet(where)
        later = names[names.index(name) :]
        kept = done.join(todo.select(key, F.explode(F.array(*map(F.lit, later))).alias("stage")), [key, "stage"], "left_anti")
        now = todo.select(key, "fingerprint", F.lit("done").alias("status"), F.lit(name).alias("stage"))
        cut(kept.select(key, "fingerprint", "status", "stage").unionByName(now)).write.mode("overwrite").parquet(ledger)
    return ran


def corrected(base: DataFrame, edits: DataFrame, keys: Sequence[str], revision: str, value: str, at: str) -> DataFrame:
    """``base`` with ``value`` replaced by the latest edit of its keys and revision, and ``corrected``; an edit of another revision is stale and left out.

    ``edits`` is (keys, revision, value, at); a null value takes the value away, edits of one instant are told apart by the greater value.
    """
    by = [*keys, revision]
    latest = edits.groupBy(*by).agg(F.max(F.struct(F.col(at), F.col(value).alias("__new")))["__new"].alias("__new"), F.lit(True).alias("__hit"))
    hit = F.coalesce("__hit", F.lit(False))
    return base.join(latest, by, "left").withColumn(value, F.when(hit, F.col("__new")).otherwise(F.col(value))).withColumn("corrected", hit).drop("__new", "__hit")
