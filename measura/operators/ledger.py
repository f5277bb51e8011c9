"""Stage ledger: which stages are current, what a change invalidates, and cached results that still serve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The stages in their order, and the states one can be in.
STAGES = ("acquire", "normalise", "separate", "lyrics", "transcribe", "tablature", "export")
STATES = ("pending", "running", "done", "error")


def fingerprint(*columns: str) -> Column:
    """Digest of a canonical JSON of the columns, sorted by name; nulls are left out of it."""
    return F.sha2(F.concat(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), F.lit("\n")), 256)


def stage_place(stage: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STAGES)), stage).cast("int") - 1


def valid_record() -> Column:
    """A stage with a known name and state, a digest of 64 hex digits and a size that isn't negative."""
    return F.coalesce(F.col("stage").isin(*STAGES) & F.col("status").isin(*STATES) & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("size") >= 0), F.lit(False))


def to_run(wanted: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` (key, stage, fingerprint) without a done entry of the same fingerprint: what is left to do."""
    done = ledger.where("status = 'done'").select(key, "stage", "fingerprint")
    return wanted.join(done, [key, "stage", "fingerprint"], "left_anti")


def invalidated(records: DataFrame, key: str) -> DataFrame:
    """``records`` with the state each stage has left once every stage after one that isn't done is pending again."""
    w = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    broken = F.max((F.col("status") != "done").cast("int")).over(w)
    return records.withColumn("effective", F.when(F.coalesce(broken, F.lit(0)) == 1, "pending").otherwise(F.col("status")))


def subsumed(cached: DataFrame, wanted: DataFrame, key: str, ranks: Sequence[tuple[str, int]]) -> DataFrame:
    """``wanted`` (key, model) with the best cached model that is no worse than the one asked for; null without one."""
    dim = F.create_map(*[F.lit(x) for kv in ranks for x in kv])
    have = cached.select(key, F.col("model").alias("cached_model"), F.try_element_at(dim, F.col("model")).alias("cached_rank"))
    both = wanted.withColumn("rank", F.try_element_at(dim, F.col("model"))).join(have, key, "left")
    good = F.when(F.col("cached_rank") >= F.col("rank"), F.struct("cached_rank", "cached_model"))
    return both.groupBy(key, "model").agg(F.max(good)["cached_model"].alias("served_by"))
