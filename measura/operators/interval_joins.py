"""Joins on time: as-of lookups, stabbing and overlap, without a nested loop over pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grid(ends: DataFrame, key: str, end: str, step: float) -> DataFrame:
    """Probes (key, t) at 0, step, 2 step, ... up to ``end`` of each key."""
    return ends.select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col(end) / step).cast("int"))).alias("__k")).select(key, (F.col("__k") * F.lit(float(step))).alias("t"))


def _laid_out(probes: DataFrame, events: DataFrame, key: str, t: str, start: str, tie: str, payload: Sequence[str]) -> DataFrame:
    """Probes and events of a key in one list: (..., __t, __probe, __tie, __event)."""
    left = probes.select("*", F.col(t).alias("__t"), F.lit(1).alias("__probe"), F.lit(None).cast(events.select(tie).dtypes[0][1]).alias("__tie"))
    right = events.select(key, F.col(start).alias("__t"), F.lit(0).alias("__probe"), F.col(tie).alias("__tie"), F.struct(*[F.col(c) for c in payload]).alias("__event"))
    return left.unionByName(right, allowMissingColumns=True)


def _carried(both: DataFrame, key: str, width: float, forward: bool) -> DataFrame:
    """``both`` with __found: the nearest event at or before (or after) each row of its key.

    Rows are ordered only within stretches of ``width``, so a key with most of the rows spreads over
    as many tasks as it has stretches; what reaches a stretch from outside comes from a list of one
    row for each stretch.
    """
    rows = both.withColumn("__b", F.floor(F.col("__t") / width))
    order = ["__t", "__probe", "__tie"]
    inside = W.partitionBy(key, "__b").orderBy(*order)
    lists = W.partitionBy(key).orderBy("__b")
    place = F.struct(*order)
    if forward:
        near = F.first("__event", ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing))
        edge, reach = F.min_by("__event", place), F.first("__edge", ignorenulls=True).over(lists.rowsBetween(1, W.unboundedFollowing))
    else:
        near = F.last("__event", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
        edge, reach = F.max_by("__event", place), F.last("__edge", ignorenulls=True).over(lists.rowsBetween(W.unboundedPreceding, -1))
    ends = rows.where("__probe = 0").groupBy(key, "__b").agg(edge.alias("__edge"))
    stretches = rows.select(key, "__b").distinct().join(ends, [key, "__b"], "left").withColumn("__reach", reach).select(key, "__b", "__reach")
    return rows.withColumn("__near", near).where("__probe = 1").join(stretches, [key, "__b"]).withColumn("__found", F.coalesce("__near", "__reach"))


def as_of(probes: DataFrame, events: DataFrame, key: str, t: str, start: str, tie: str, payload: Sequence[str], width: float = 120.0) -> DataFrame:
    """``probes`` with ``payload`` of the last event that starts at or before ``t`` (the largest ``tie`` of one start); null without one.

    Both sides are laid into one order and the last event is carried forward; no pair of a probe and
    an event is formed, and no task holds more than a stretch of ``width`` of one key. Probes with a null key or time are left out.
    """
    found = _carried(_laid_out(probes, events, key, t, start, tie, payload), key, width, False)
    return found.select(*probes.columns, *[F.col(f"__found.{c}").alias(c) for c in payload])


def next_of(probes: DataFrame, events: DataFrame, key: str, t: str, start: str, tie: str, payload: Sequence[str], width: float = 120.0) -> DataFrame:
    """``probes`` with ``payload`` of the first event that starts after ``t`` (the smallest ``tie`` of one start); null without one."""
    found = _carried(_laid_out(probes, events, key, t, start, tie, payload), key, width, True)
    return found.select(*probes.columns, *[F.col(f"__found.{c}").alias(c) for c in payload])


def overlap_join(left: DataFrame, right: DataFrame, key: str, l_span: tuple[str, str], r_span: tuple[str, str], width: float, how: str = "inner") -> DataFrame:
    """Pairs of one key whose spans overlap: min(ends) > max(starts), so touching spans don't.

    Each span goes into the buckets of ``width`` that it crosses; rows meet in a bucket by an
    equi join, and a pair is kept in the first bucket they share, so it comes out once. ``left_semi``
    keeps each left row that meets any. Choose ``width`` near the usual length of a span.
    """
    (ls, le), (rs, re_) = l_span, r_span
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = lambda df, a, b: df.withColumn("__b", F.explode(F.sequence(bucket(a), F.greatest(bucket(a), F.ceil(F.col(b) / width) - 1))))
    lhs, rhs = spread(left, ls, le).alias("l"), spread(right, rs, re_).alias("r")
    meet = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.__b") == F.col("r.__b")) & (F.least(f"l.{le}", f"r.{re_}") > F.greatest(f"l.{ls}", f"r.{rs}"))
    if how == "left_semi":
        return lhs.join(rhs, meet, "left_semi").drop("__b").distinct()
    first = F.col("l.__b") == F.greatest(F.floor(F.col(f"l.{ls}") / width), F.floor(F.col(f"r.{rs}") / width))
    right_only = [F.col(f"r.{c}") for c in right.columns if c != key]
    return lhs.join(rhs, meet & first).select(*[F.col(f"l.{c}") for c in left.columns], *right_only)


def stabs(events: DataFrame, start: Column, end: Column, step: float) -> DataFrame:
    """One row for each probe k * step with start <= t < end: ``events`` with column ``t``; probes on a grid need no join."""
    k = F.sequence(F.ceil(start / step).cast("int"), (F.ceil(end / step) - 1).cast("int"))
    some = F.ceil(start / step) <= F.ceil(end / step) - 1
    return events.where(some).withColumn("__k", F.explode(k)).where("__k >= 0").withColumn("t", F.col("__k") * F.lit(float(step))).drop("__k")
