"""Batch twins of the streaming operators, and reports over grouped results."""

from __future__ import annotations

from pyspark.sql import functions as F

from measura.plans.grouped import j13_alignment
from measura.session import table
from measura.streaming import stateful as S


def _events(spark, d):
    instant = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))  # whatever the session's time zone
    return table(spark, d, "events").select("event_id", "user_id", "event_type", instant.alias("ts"), "value")


def stream_density(spark, d):
    """Events of each type in tumbling hours."""
    out = S.density(_events(spark, d), "event_type", "ts", "1 hour")
    return out.select("event_type", F.unix_micros("bucket").alias("hour_us"), "n")


def stream_sessions(spark, d):
    """Sessions of each user: an event lasts its value in seconds and the next joins within half an hour of its end."""
    e = _events(spark, d).select("user_id", "ts", F.col("value").alias("seconds"))
    out = S.sessions(e, "user_id", "ts", "seconds", 1800.0)
    return out.select("user_id", F.unix_micros("first").alias("first_us"), "n")


def d12_grades(spark, d):
    """How many pairs of a sheet and an attempt of a song align well, fairly or poorly, and how much of their text is matched."""
    return j13_alignment(spark, d).groupBy("grade").agg(F.count("*").alias("alignments"), F.round(F.avg("matched_fraction"), 4).alias("matched"))


QUERIES = {f.__name__: f for f in (stream_density, stream_sessions, d12_grades)}
ORACLES = {
    "stream_density": "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(round((value + 1800.0::DOUBLE) * 1000000) AS BIGINT) AS z FROM events), r AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, z, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM r) SELECT user_id, min(a) AS first_us, count(*) AS n FROM i GROUP BY user_id, isl",
}
