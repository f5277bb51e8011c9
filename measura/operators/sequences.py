"""Order-sensitive operators over cues and words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD_GAP, MIN_DISPLAY, LONG_HOLD, RUN_CAP = 1.0, 1.2, 6.0, 12
SUNG_LEAD, SUNG_WORD = 0.35, 0.55


def total_order(key: str, *order: str):
    return W.partitionBy(key).orderBy(*order)


def split_gaps(words: DataFrame, key: str, gap: float = WORD_GAP) -> DataFrame:
    """``words`` with ``part``: a new part wherever a word starts more than ``gap`` after the end of the word before it."""
    w = total_order(key, "start", "end", "word_id")
    cut = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(0))
    return words.withColumn("__cut", cut).withColumn("part", F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__cut")


def islands(df: DataFrame, key: str, order: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """``df`` with the number of the run of equal consecutive values that a row stands in."""
    w = total_order(key, *order)
    cut = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    return df.withColumn("__cut", F.when(F.row_number().over(w) == 1, 0).otherwise(cut)).withColumn(name, F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__cut")


def cap_runs(df: DataFrame, key: str, order: Sequence[str], value: str, most: int = RUN_CAP) -> DataFrame:
    """``df`` without the rows of a run of equal values beyond its first ``most``."""
    marked = islands(df, key, order, value, "__run")
    place = F.row_number().over(W.partitionBy(key, "__run").orderBy(*order))
    return marked.withColumn("__place", place).where(F.col("__place") <= most).drop("__run", "__place")


def sung_seconds(text: Column) -> Column:
    """Time that singing a line takes, from its number of words."""
    return F.lit(SUNG_LEAD) + F.size(F.split(F.trim(text), r"\s+")) * F.lit(SUNG_WORD)


def trim_hold(start: Column, end: Column, text: Column) -> Column:
    """End of a cue held over an instrumental: cut when it lasts over six seconds and over three times its singing."""
    sung = sung_seconds(text)
    return F.when(((end - start) > LONG_HOLD) & ((end - start) > sung * 3), F.least(end, F.greatest(start + F.lit(MIN_DISPLAY), start + sung + F.lit(1.0)))).otherwise(end)


def min_display(df: DataFrame, key: str, order: Sequence[str], least: float = MIN_DISPLAY) -> DataFrame:
    """``df`` with ``end`` long enough to read but not past the next start."""
    nxt = F.lead("start").over(total_order(key, *order))
    want = F.greatest(F.col("end"), F.col("start") + F.lit(least))
    return df.withColumn("end", F.greatest(F.col("start"), F.least(want, F.coalesce(nxt, want))))


def weight(text: Column) -> Column:
    """Letters and digits of a word, at least one."""
    return F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.lit(1))


def spread_words(cues: DataFrame, key: str) -> DataFrame:
    """One row for each word of each cue, its time a share of the cue's in proportion to its letters."""
    words = cues.select(key, "start", "end", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("word_ix", "word"))
    words = words.where("word <> ''").withColumn("__w", weight(F.col("word")))
    whole = W.partitionBy(key)
    upto = F.sum("__w").over(whole.orderBy("word_ix").rowsBetween(W.unboundedPreceding, 0))
    span, total = F.col("end") - F.col("start"), F.sum("__w").over(whole)
    return words.select(key, "word_ix", "word", F.round(F.col("start") + span * (upto - F.col("__w")) / total, 9).alias("word_start"), F.round(F.col("start") + span * upto / total, 9).alias("word_end"))


def gap_tiles(df: DataFrame, key: str, order: Sequence[str], least: float = 1.2, tile: float = 6.0) -> DataFrame:
    """Tiles of at most ``tile`` seconds that fill the gaps over ``least`` seconds between an end and the next start."""
    nxt = F.lead("start").over(total_order(key, *order))
    gaps = df.withColumn("__next", nxt).where(F.col("__next") - F.col("end") > least)
    n = F.ceil((F.col("__next") - F.col("end")) / tile).cast("int")
    tiles = gaps.select(key, "end", "__next", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return tiles.select(key, (F.col("end") + F.col("k") * F.lit(tile)).alias("tile_start"), F.least(F.col("__next"), F.col("end") + (F.col("k") + 1) * F.lit(tile)).alias("tile_end"))


def latched(df: DataFrame, key: str, order: str, label: str, silent: Column, hold: float = 0.25) -> DataFrame:
    """Rows where a named label has stood long enough to be shown.

    Ticks without a name neither replace the label nor reset its timer, silence clears both, so the
    named ticks between two silences form islands of equal labels; an island shows from its first tick
    that is ``hold`` after its start.
    """
    w = total_order(key, order)
    parts = df.withColumn("__quiet", F.sum(silent.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    named = parts.where(F.col(label).isNotNull() & ~silent)
    v = W.partitionBy(key, "__quiet").orderBy(order)
    cut = F.coalesce((F.lag(label).over(v) != F.col(label)).cast("int"), F.lit(0))
    isl = named.withColumn("__cut", cut).withColumn("__isl", F.sum("__cut").over(v.rowsBetween(W.unboundedPreceding, 0)))
    since = F.min(order).over(W.partitionBy(key, "__quiet", "__isl"))
    shown = isl.withColumn("__since", since).where(F.col(order) - F.col("__since") >= hold)
    return shown.groupBy(key, "__quiet", "__isl", label).agg(F.min(order).alias("shown_at")).select(key, label, "shown_at")


def better(kept: tuple, other: tuple) -> tuple[bool, str]:
    """Whether ``other`` replaces the attempt kept so far, and why; both are (attempt, covered, score), covered null without cues."""
    (_, p, s), (_, q, t) = kept, other
    if q is None or p is None:
        return q is not None, "empty"
    if q < p * 0.6 or p < q * 0.6:
        return q >= p * 0.6, "coverage"
    if t > s + 0.05 or s > t + 0.05:
        return t > s + 0.05, "score"
    return False, "tie"


def choose_attempts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(song, attempt, reason) of (song, attempt, covered, score) in the order of song and attempt; holds one attempt at a time."""
    now: list | None = None  # song, attempt kept, reason

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["song_id", "attempt_id", "reason"])

    for b in batches:
        out = []
        for song, *attempt in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now[0] != song:
                if now is not None:
                    out.append((now[0], now[1][0], now[2]))
                now = [song, attempt, "single"]
            else:
                replaced, now[2] = better(now[1], attempt)
                now[1] = attempt if replaced else now[1]
        if out:
            yield batch(out)
    if now is not None:
        yield batch([(now[0], now[1][0], now[2])])


def edit_loops(least: float, usual: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A fold of (player, what, position), ordered by player and time, to (player, start, end, active, refused edits); holds one player at a time."""

    def edited(now: tuple[float, float, bool, int], what: str, at: float) -> tuple[float, float, bool, int]:
        start, end, _, refused = now
        if what == "signup":
            return 0.0, 0.0, False, refused
        start, end = (at, end if end > at else at + usual) if what == "click" else (start, at)
        fine = end - start >= least
        return start, end, fine, refused + (not fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player, now = None, (0.0, 0.0, False, 0)
        names, kinds = ("user_id", "loop_start", "loop_end", "active", "refused"), (pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
        shut = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            out = []
            for who, what, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if who != player:
                    if player is not None:
                        out.append((player, *now))
                    player, now = who, (0.0, 0.0, False, 0)
                now = edited(now, what, at)
            if out:
                yield shut(out)
        if player is not None:
            yield shut([(player, *now)])

    return run
