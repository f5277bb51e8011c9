"""Packing of items into containers of fixed capacity.

Bounded-space online packing: each partition keeps a fixed number of open windows, puts an item
into the fullest window that still has room for it, and closes the fullest window when none has.
The windows still open at the end of the partitions, a fixed number for each, are merged.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measura.session import cut

#: open windows of a partition for each capacity
WINDOWS = 64
#: partitions whose leftover windows are merged together
FAN_IN = 1024


class Packer:
    """The open windows of one partition for one capacity."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (fill, window), ascending
        self.next = 0

    def place(self, size: int) -> int:
        """The window that takes an item of ``size`` <= capacity."""
        at = bisect_left(self.open, (self.capacity - size + 1, -1)) - 1  # the fullest one with room
        if at >= 0:
            fill, window = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                self.open.pop()  # the fullest closes
            fill, window = 0, self.next
            self.next += 1
        if fill + size < self.capacity:
            insort(self.open, (fill + size, window))
        return window


def split_sizes(size: int, capacity: int) -> list[tuple[int, int]]:
    """The pieces of an item as (first, last + 1) unit; one piece unless it exceeds the capacity."""
    if size <= capacity:
        return [(0, size)]
    return [(a, min(a + capacity, size)) for a in range(0, size, capacity)]


def pack(items: DataFrame, key: str, size: str, capacities: Sequence[tuple[str, int]], windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """(pack_name, container_id, key, piece_ix, from_unit, to_unit): the container of each piece.

    ``items`` has a BIGINT key and a size in units; a null size counts as 0 and an item of size 0
    still gets a container. An item is split only when it exceeds the capacity, into full pieces
    and a rest. Repeated keys are items of their own; null keys are kept; an empty input gives an
    empty result. ``container_id`` is unique within a pack and no container holds more than its
    capacity. Each row of the input gives rows for each (name, capacity > 0).

    Nothing is shuffled but the leftover windows (``windows`` for each partition and capacity):
    those of ``fan_in`` partitions meet in one task and are packed again, largest first.
    """
    caps = [(str(n), int(c)) for n, c in capacities]
    if any(c <= 0 for _, c in caps):
        raise ValueError("capacities must be positive")
    schema = f"pack_ix int, pid int, window long, is_open boolean, `{key}` long, piece_ix int, from_unit int, to_unit int"
    names = ["pack_ix", "pid", "window", "is_open", key, "piece_ix", "from_unit", "to_unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        packers = [Packer(c, windows) for _, c in caps]

        def rows(data: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*data, strict=True))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for b in batches:
            out = []
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for ix, p in enumerate(packers):
                    for piece, (first, last) in enumerate(split_sizes(n or 0, p.capacity)):
                        out.append((ix, pid, p.place(last - first), False, k, piece, first, last))
                if len(out) > 50_000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)
        left = [(ix, pid, w, True, None, None, None, fill) for ix, p in enumerate(packers) for fill, w in p.open]
        if left:
            yield rows(left)

    placed = cut(items.select(F.col(key).cast("long").alias(key), F.col(size).cast("int").alias("__n")).mapInArrow(run, schema))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "pid", "window"], ascending=[False, True, True])
        capacity = caps[int(group["pack_ix"].iloc[0])][1]
        packer = Packer(capacity, len(group) + 1)
        to = np.array([packer.place(int(n)) for n in group["fill"]])
        first = pd.Series(np.arange(len(to))).groupby(to).min()
        rep = first[to].to_numpy()
        return group[["pack_ix", "pid", "window"]].assign(to_pid=group["pid"].to_numpy()[rep], to_window=group["window"].to_numpy()[rep])

    left = placed.where("is_open").select("pack_ix", "pid", "window", F.col("to_unit").alias("fill"))
    moved = left.groupBy("pack_ix", F.floor(F.col("pid") / fan_in)).applyInPandas(lambda g: merge(g), "pack_ix int, pid int, window long, to_pid int, to_window long")
    found = placed.where("NOT is_open").join(moved, ["pack_ix", "pid", "window"], "left")
    container = F.shiftleft(F.coalesce("to_pid", "pid").cast("long"), 40) + F.coalesce("to_window", "window")
    label = F.element_at(F.array(*(F.lit(n) for n, _ in caps)), F.col("pack_ix") + 1) if caps else F.lit(None).cast("string")
    return found.select(label.alias("pack_name"), container.alias("container_id"), F.col(key), "piece_ix", "from_unit", "to_unit")
