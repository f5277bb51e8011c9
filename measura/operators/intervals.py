"""Interval coverage: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measura.operators.rangescan import OrderedScan

_S, _E, _K = "__start", "__end", "__key"


def _running_max(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Running maximum that starts again with each segment (segments are numbered 0, 1, ...)."""
    if not len(values):
        return values
    low = int(values.min())
    span = int(values.max()) - low + 1
    if span * (int(segment[-1]) + 1) < 2**62:
        lifted = (values - low) + segment * span
        return np.maximum.accumulate(lifted) - segment * span + low
    out = values.copy()
    for first, last in zip(*_edges(segment), strict=True):
        out[first:last] = np.maximum.accumulate(values[first:last])
    return out


def _edges(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    return first, np.r_[first[1:], len(segment)]


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    a, b = column[:-1], column[1:]
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return np.asarray(pc.or_(unequal, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False))


class _Walk:
    """State of a scan in global order: the open island of the entity seen last."""

    def __init__(self, entity: Sequence[str], open_: dict[str, Any] | None = None):
        self.entity, self.open = list(entity), open_
        self.last: tuple | None = None  # the row seen last, to leave out its repetitions
        self.first_entity: tuple | None = None
        self.own = 0  # rows of the last entity

    def feed(self, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
        """Islands that end here: (entity columns, start, end, n, gap_to or -1 without a gap)."""
        n = batch.num_rows
        new_entity = np.zeros(n, bool)
        for c in self.entity:
            new_entity[1:] |= _differs(batch.column(c))
        s, e, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in (_S, _E, _K))
        row = lambda i: tuple(batch.column(c)[i].as_py() for c in self.entity)
        head = row(0)
        same = self.open is not None and self.open["entity"] == head
        new_entity[0] = not same
        repeat = np.zeros(n, bool)
        repeat[1:] = ~new_entity[1:] & (s[1:] == s[:-1]) & (e[1:] == e[:-1]) & (k[1:] == k[:-1])
        repeat[0] = self.last == (head, s[0], e[0], k[0])
        self.last = (row(n - 1), s[-1], e[-1], k[-1])
        if self.first_entity is None:
            self.first_entity = head
        keep = ~repeat
        index = np.flatnonzero(keep)
        starts = np.flatnonzero(new_entity)
        self.own = int(keep[starts[-1] :].sum()) if len(starts) else self.own + int(keep.sum())
        if not len(index):
            return batch.slice(0, 0), {c: np.zeros(0, np.int64) for c in ("start", "end", "n", "gap_to")}
        s, e, segment, weight = s[index], e[index], np.cumsum(new_entity)[index], np.ones(len(index), np.int64)
        if self.open is not None:  # the open island comes first, as one row
            index = np.r_[-1, index]
            s, e = np.r_[self.open["start"], s], np.r_[self.open["end"], e]
            segment, weight = np.r_[0, segment], np.r_[self.open["n"], weight]
        segment = np.cumsum(np.r_[0, segment[1:] != segment[:-1]])
        reach = _running_max(e, segment)
        fresh = np.ones(len(s), bool)
        fresh[1:] = (segment[1:] != segment[:-1]) | (s[1:] > reach[:-1])
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(s)] - 1
        start, end, count = s[first], reach[last], np.add.reduceat(weight, first)
        gap_to = np.full(len(first), -1, np.int64)
        has_gap = np.zeros(len(first), bool)
        has_gap[:-1] = segment[first[1:]] == segment[first[:-1]]
        gap_to[:-1] = np.where(has_gap[:-1], start[1:], -1)
        owner = index[first]
        opened = self.open
        self.open = {"entity": opened["entity"] if owner[-1] < 0 else row(int(owner[-1])), "start": int(start[-1]), "end": int(end[-1]), "n": int(count[-1])}
        shut = slice(0, len(first) - 1)
        columns = batch.select(self.entity)
        if owner[0] < 0:
            carried = pa.RecordBatch.from_pylist([dict(zip(self.entity, opened["entity"], strict=True))], schema=columns.schema)
            columns = pa.Table.from_batches([carried, columns]).combine_chunks().to_batches()[0]
            owner = owner + 1
        return columns.take(pa.array(owner[shut])), {"start": start[shut], "end": end[shut], "n": count[shut], "gap_to": gap_to[shut], "has_gap": has_gap[shut]}


def _carry(parts: dict[int, dict[str, Any]]) -> dict[int, dict[str, Any] | None]:
    """The open island that reaches each partition: the summaries combined from the left."""
    open_, out = None, {}
    for pid, p in parts.items():
        out[pid] = open_
        single = p["first"] == p["entity"]
        if open_ is not None and single and open_["entity"] == p["entity"] and p["start"] <= open_["end"]:
            open_ = open_ | {"end": max(open_["end"], p["end"]), "n": open_["n"] + p["own"]}
        else:
            open_ = {k: p[k] for k in ("entity", "start", "end", "n")}
    return out


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: str, end: str, key: str, partitions: int | None = None) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    ``start`` and ``end`` are BIGINT instants, ``key`` a BIGINT that tells records apart: a record
    that stands several times (same entity, key, start and end) counts once. Rows with a null start,
    end or key, or an end before the start, are left out; a null entity value is an entity of its own. Intervals
    that overlap, nest or touch join. Result: the entity columns, ``what`` (period or gap), ``from_at``, ``to_at``, ``n``: one row for
    each period of two or more records, and one for each gap between neighbouring stretches (of one
    record or more). An empty input gives an empty result; other columns of the input are ignored.

    The rows are range-sorted by (entity, start), partition summaries (last entity, its last island
    and maximum end) are prefix-combined, and a rescan with the carried state labels the islands.
    One shuffle; an entity with most of the rows spreads over many partitions.
    """
    entity = list(entity)
    rows = df.select(*entity, F.col(start).cast("long").alias(_S), F.col(end).cast("long").alias(_E), F.col(key).cast("long").alias(_K))
    rows = rows.where(F.col(_S).isNotNull() & F.col(_K).isNotNull() & (F.col(_E) >= F.col(_S)))
    types = dict(df.select(*entity).dtypes)
    scan = OrderedScan(rows, [*entity, _S, _E, _K], partitions)

    def summarise(batches: Iterator[pa.RecordBatch]) -> dict[str, Any] | None:
        walk = _Walk(entity)
        for b in batches:
            if b.num_rows:
                walk.feed(b)
        if walk.open is None:
            return None
        o = walk.open
        return {"first": dict(zip(entity, walk.first_entity, strict=True)), "entity": dict(zip(entity, o["entity"], strict=True)), "start": o["start"], "end": o["end"], "n": o["n"], "own": walk.own}

    struct = f"struct<{', '.join(f'`{c}`: {types[c]}' for c in entity)}>"
    parts = scan.summaries(summarise, f"first {struct}, entity {struct}, start long, end long, n long, own long")
    for p in parts.values():
        p["first"], p["entity"] = (tuple(p[x][c] for c in entity) for x in ("first", "entity"))
    carry = _carry(parts)
    final = max(parts, default=-1)

    def emit(columns: pa.RecordBatch, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for what, mask, a, b in (("period", x["n"] >= 2, x["start"], x["end"]), ("gap", x["has_gap"], x["end"], x["gap_to"])):
            at = np.flatnonzero(mask)
            if len(at):
                picked = columns.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array([what] * len(at)), pa.array(a[at]), pa.array(b[at]), pa.array(x["n"][at] if what == "period" else np.zeros(len(at), np.int64))], names=[*entity, "what", "from_at", "to_at", "n"])

    def relabel(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, schema = _Walk(entity, carry.get(pid)), None
        for b in batches:
            if b.num_rows:
                schema = b.select(entity).schema
                columns, x = walk.feed(b)
                if columns.num_rows:
                    yield from emit(columns, x)
        if pid == final and walk.open is not None and schema is not None:
            o = walk.open
            columns = pa.RecordBatch.from_pylist([dict(zip(entity, o["entity"], strict=True))], schema=schema)
            yield from emit(columns, {"start": np.array([o["start"]]), "end": np.array([o["end"]]), "n": np.array([o["n"]]), "gap_to": np.array([-1]), "has_gap": np.array([False])})

    return scan.rescan(relabel, f"{', '.join(f'`{c}` {types[c]}' for c in entity)}, what string, from_at long, to_at long, n long")


def prefix_max(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` (entity, order and value columns) with ``name``: the greatest BIGINT ``value`` of the entity up to each row in ``order``.

    Rows with a null value are left out. The order is global, so an entity may hold any share of the rows.
    """
    entity, order = list(entity), list(order)
    rows = df.select(*entity, *order, F.col(value).cast("long").alias(value)).where(F.col(value).isNotNull())
    scan = OrderedScan(rows, [*entity, *order], ties=[value])
    types = dict(rows.dtypes)

    def marked(batch: pa.RecordBatch, before: tuple | None) -> tuple[np.ndarray, tuple, tuple]:
        new = np.zeros(batch.num_rows, bool)
        for c in entity:
            new[1:] |= _differs(batch.column(c))
        row = lambda i: tuple(batch.column(c)[i].as_py() for c in entity)
        new[0] = before is None or before != row(0)
        return new, row(0), row(batch.num_rows - 1)

    def runs(batches: Iterator[pa.RecordBatch], last: tuple | None, reach: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple, tuple]]:
        for b in batches:
            new, first, end = marked(b, last)
            v = b.column(value).to_numpy(zero_copy_only=False).copy()
            if not new[0] and reach is not None:
                v[0] = max(v[0], reach)
            top = _running_max(v, np.cumsum(new) - new[0])
            last, reach = end, int(top[-1])
            yield b, top, first, end

    def summarise(batches: Iterator[pa.RecordBatch]) -> dict[str, Any] | None:
        first = end = reach = None
        for _, top, head, end in runs(batches, None, None):  # noqa: B007
            first, reach = first or head, int(top[-1])
        return None if first is None else {"first": dict(zip(entity, first, strict=True)), "last": dict(zip(entity, end, strict=True)), "reach": reach}

    struct = f"struct<{', '.join(f'`{c}`: {types[c]}' for c in entity)}>"
    carry: dict[int, tuple[tuple | None, int | None]] = {}
    last, reach = None, None
    for pid, p in scan.summaries(summarise, f"first {struct}, last {struct}, reach long").items():
        carry[pid] = (last, reach)
        head, end = (tuple(p[x][c] for c in entity) for x in ("first", "last"))
        last, reach = end, max(p["reach"], reach) if head == end == last and reach is not None else p["reach"]

    def number(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, top, _, _ in runs(batches, *carry.get(pid, (None, None))):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top, pa.int64())], names=[*b.schema.names, name])

    return scan.rescan(number, ", ".join(f"`{c}` {t}" for c, t in types.items()) + f", `{name}` long")
