"""Runs of identical or near-identical consecutive events, each collapsed into one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measura.llm.unify import folded
from measura.operators.rangescan import OrderedScan
from measura.session import cut

#: Interjections and vocables, which come and go without changing a line, and words that only lead into one when they open it.
INTERJECTIONS = frozenset("oh ah eh uh ho ha hey hei ey ay yeah yea yo wo woah whoa wow mm hm uhm um na la da ой ах эх ох эй о".split())
LEAD_INS = frozenset(("and",))

_WORDS = re.compile(r"[^\W_]+")
_DOUBLED = re.compile(r"(.)\1+")


@lru_cache(100_000)
def line_key(text: str) -> tuple[str, str]:
    """(letters of the line without interjections and lead-ins, its interjections); letters in a row count once."""
    words = [_DOUBLED.sub(r"\1", w) for w in _WORDS.findall(folded(text).replace("'", ""))]
    first = next((i for i, w in enumerate(words) if w not in LEAD_INS and w not in INTERJECTIONS), len(words))
    words = [w for i, w in enumerate(words) if i >= first or w not in LEAD_INS]
    said = "".join(w for w in words if w not in INTERJECTIONS)
    return said, "" if said else " ".join(sorted(set(words)))


def within(a: str, b: str, most: int) -> bool:
    """Whether ``b`` is at most ``most`` edits (insert, delete, replace, swap neighbours) from ``a``."""
    if abs(len(a) - len(b)) > most:
        return False
    first = 0
    short = min(len(a), len(b))
    while first < short and a[first] == b[first]:
        first += 1
    last = 0
    while last < short - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if max(len(a), len(b)) <= 1:
        return max(len(a), len(b)) <= most
    if not a or not b:
        return max(len(a), len(b)) <= most
    if len(set(a) ^ set(b)) > 2 * most:
        return False
    far = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            y = b[j - 1]
            best = min(row.get(j - 1, far) + (x != y), row.get(j, far) + 1, now.get(j - 1, far) + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before.get(j - 2, far) + 1)
            now[j] = best
        if min(now.values()) > most:
            return False
        before, row = row, now
    return row.get(len(b), far) <= most


def same_line(one: str, other: str) -> bool:
    """Whether two lines are the same but for case, punctuation, spacing, look-alike characters, drawn-out letters, interjections and slips.

    One slip is granted to a line of eight letters, two from twenty (each of the two may have
    one); a script that writes words in a letter or two is granted one from twelve.
    """
    if one == other:
        return True
    (a, x), (b, y) = line_key(one), line_key(other)
    if a == b:
        return bool(a) or x == y
    if not a or not b:
        return False
    short = min(len(a), len(b))
    dense = sum(c > "⺀" for c in a) * 2 > len(a)
    return within(a, b, (1 if short >= 12 else 0) if dense else 2 if short >= 20 else 1 if short >= 8 else 0)


def roots(links: DataFrame, index: str, pointer: str, payload: Sequence[str] = ()) -> DataFrame:
    """``links`` with each pointer replaced by the start of its chain, by pointer doubling.

    A row points to the index before it in its chain; an index that isn't in ``links`` is a
    start. Each round joins the pointers with themselves and doubles the distance they span, so a
    chain of n rows takes log2(n) rounds; the rounds end when none changes a pointer. Every
    round is checkpointed, so neither the plan nor what a lost executor costs grows.
    """
    payload = list(payload)
    base = cut(links.select(index, pointer, *payload))
    now = base.select(index, pointer)  # only the pointers go through the rounds
    while True:
        ahead = now.select(F.col(index).alias("__at"), F.col(pointer).alias("__to"))
        now = cut(now.join(ahead, F.col(pointer) == F.col("__at"), "left").select(index, F.coalesce("__to", pointer).alias(pointer), F.col("__to").isNotNull().alias("__moved")))
        moved = not now.where("__moved").isEmpty()
        now = now.drop("__moved")
        if not moved:
            return base.drop(pointer).join(now, index) if payload else now


def collapse_runs(df: DataFrame, entity: str, start: str, key: str, text: str, end: str | None = None, same: Callable[[str, str], bool] = same_line) -> DataFrame:
    """(entity, first_key, last_key, n, start, end) of each longest run of two or more like events.

    Events of an entity stand in the order of ``start``, then ``key`` (BIGINT); each is compared
    with the one before it. Rows with a null entity, key or start, a NaN start, or a null or blank text are left
    out first; rows repeated under the same entity, start and key count once. A null, NaN or
    backward ``end`` counts as the start. Other columns are not read; an empty table gives an empty
    result. The order is global (range partitions with the last event carried over the border), so
    an entity may hold any share of the rows.
    """
    kept = df.where(F.col(entity).isNotNull() & F.col(key).isNotNull() & F.col(start).isNotNull() & ~F.isnan(start) & (F.trim(F.regexp_replace(F.col(text), r"[\p{Z}\s\p{Cf}]", "")) != ""))
    until = F.col(end) if end else F.col(start)
    rows = kept.select(F.col(entity).cast("long").alias("e"), F.col(start).cast("double").alias("s"), F.col(key).cast("long").alias("k"), F.when(until > F.col(start), F.nanvl(until, F.col(start))).otherwise(F.col(start)).cast("double").alias("u"), F.col(text).alias("t"))
    scan = OrderedScan(rows, ["e", "s", "k"], ties=["u", "t"])

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None or row[:3] != last:
                    last = row[:3]
                    yield row

    def summarise(batches: Iterator[pa.RecordBatch]) -> dict[str, Any] | None:
        n, row = 0, None
        for n, row in enumerate(events(batches), 1):  # noqa: B007
            pass
        return row and dict(zip("eskut", row, strict=True)) | {"n": n}

    parts = scan.summaries(summarise, "e long, s double, k long, u double, t string, n long")
    carry, offset, before = {}, 0, None
    for pid, p in parts.items():
        carry[pid] = (offset, before)
        offset, before = offset + p["n"], tuple(p[c] for c in "eskut")

    schema = "at long, e long, k long, s double, u double, k0 long, s0 double, u0 double"
    names = ["at", "e", "k", "s", "u", "k0", "s0", "u0"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]

    def link(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = carry.get(pid, (0, None))
        out: list[tuple] = []
        for row in events(batches):
            e, s, k, u, t = row
            if last is not None and last[0] == e and same(last[4], t):
                out.append((at, e, k, s, u, last[2], last[1], last[3]))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            last, at = row, at + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)], names=names)

    linked = scan.rescan(link, schema).withColumn("to", F.col("at") - 1)
    rooted = roots(linked, "at", "to", ["e", "k", "s", "u", "k0", "s0", "u0"])
    out = rooted.groupBy("to").agg(F.min("e").alias(entity), F.min_by("k0", "at").alias("first_key"), F.max_by("k", "at").alias("last_key"), (F.count("*") + 1).alias("n"), F.min_by("s0", "at").alias("start"), F.max(F.greatest("u", "u0")).alias("end"))
    return out.drop("to")
