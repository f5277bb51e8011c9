"""Problem 4: periods and gaps of cues, words and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measura.operators.intervals import periods_and_gaps
from measura.session import table

#: record kind, table, owner column, key column
SOURCES = (("cue", "raw_cues", "attempt_id", "cue_id"), ("word", "lyric_words", "attempt_id", "word_id"), ("note", "notes", "run_id", "note_id"))


def timed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All timed records as (kind_ix, owner_id, rec_id, from_us, to_us); unusable times are left out."""
    parts = []
    for ix, (_, name, owner, key) in enumerate(SOURCES):
        t = table(spark, sf_dir, name)
        finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        us = lambda c: F.round(F.col(c) * 1e6).cast("long")
        parts.append(t.where(finite("start_s") & finite("end_s") & (F.col("end_s") > F.col("start_s"))).select(F.lit(ix).cast("tinyint").alias("kind_ix"), F.col(owner).alias("owner_id"), F.col(key).alias("rec_id"), us("start_s").alias("from_us"), us("end_s").alias("to_us")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of two or more records and gaps, for each attempt (cues, words) and run (notes)."""
    out = periods_and_gaps(timed_records(spark, sf_dir), ["kind_ix", "owner_id"], "from_us", "to_us", "rec_id")
    kinds = F.array(*(F.lit(k) for k, *_ in SOURCES))
    return out.select(F.element_at(kinds, F.col("kind_ix").cast("int") + 1).alias("rec_kind"), "owner_id", "what", F.col("from_at").alias("from_us"), F.col("to_at").alias("to_us"))


_RECORDS = " UNION ALL ".join(
    f"SELECT DISTINCT '{kind}' AS rec_kind, {owner} AS owner_id, {key} AS rec_id, CAST(round(start_s * 1e6) AS BIGINT) AS s, CAST(round(end_s * 1e6) AS BIGINT) AS e FROM {name} "
    f"WHERE isfinite(start_s) AND isfinite(end_s) AND end_s > start_s"
    for kind, name, owner, key in SOURCES
)
P4_SQL = f"""
WITH r AS ({_RECORDS}),
m AS (SELECT *, max(e) OVER (PARTITION BY rec_kind, owner_id ORDER BY s, e, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec_kind, owner_id ORDER BY s, e, rec_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT rec_kind, owner_id, island, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT *, lead(s) OVER (PARTITION BY rec_kind, owner_id ORDER BY s) AS nxt FROM p)
SELECT rec_kind, owner_id, 'period' AS what, s AS from_us, e AS to_us FROM p WHERE n >= 2
UNION ALL
SELECT rec_kind, owner_id, 'gap' AS what, e AS from_us, nxt AS to_us FROM g WHERE nxt IS NOT NULL
"""

QUERIES = {"p4_found": p4_found}
ORACLES = {"p4_found": P4_SQL}
