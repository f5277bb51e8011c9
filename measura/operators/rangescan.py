"""Globally ordered scans: a range partitioning read twice, with state carried over its borders.

A window function over ``PARTITION BY entity`` puts a whole entity into one task. Here the rows
are range-partitioned on (entity, order), so a hot entity spreads over as many partitions as its
rows need. A first pass gives one summary row for each partition, the summaries are folded in
partition order (one row each: their number is the number of partitions, never of rows), and a
second pass scans each partition again with the state that reaches its border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PID = "__pid"


def _by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(partition number, its batches without that column); a task that reads several partitions sees each by itself."""

    def slices() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            if not b.num_rows:
                continue
            own, names = b.column(_PID).to_numpy(zero_copy_only=False), [n for n in b.schema.names if n != _PID]
            rest = b.select(names)
            borders = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)].tolist()
            for at, to in zip(borders, borders[1:], strict=False):
                yield int(own[at]), rest.slice(at, to - at)

    for pid, parts in groupby(slices(), itemgetter(0)):
        yield pid, (b for _, b in parts)


class OrderedScan:
    """``df`` in global order of ``keys``, held so that both passes see the same partitions.

    The partitions stay on executor disks; a lost block is computed again from the range
    shuffle with the same borders, so the passes agree even when executors are lost. Each row
    holds the number of its partition, so the passes don't depend on the task that reads it: results may be
    unioned, coalesced or joined.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str | Column], partitions: int | None = None, ties: Sequence[str | Column] = ()):
        """``ties`` order rows of equal keys, which always share a partition, so that a recomputed block equals the lost one."""
        ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
        self.df = ranged.sortWithinPartitions(*keys, *ties).withColumn(_PID, F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)

    def summaries(self, summarise: Callable[[Iterator[pa.RecordBatch]], dict[str, Any] | None], schema: str) -> dict[int, dict[str, Any]]:
        """First pass. One row for each partition that isn't empty, by partition number."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pid, own in _by_partition(batches):
                row = summarise(own)
                if row is not None:
                    yield pa.RecordBatch.from_pylist([{"pid": pid, **row}], schema=out)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        full = f"pid int, {schema}"
        out = to_arrow_schema(_parse_datatype_string(full))
        rows = self.df.mapInArrow(one, full).collect()
        return {r["pid"]: r.asDict() for r in sorted(rows, key=lambda r: r["pid"])}

    def rescan(self, scan: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Second pass: ``scan(partition number, batches)``."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pid, own in _by_partition(batches):
                yield from scan(pid, own)

        return self.df.mapInArrow(one, schema)


def numbered(df: DataFrame, keys: Sequence[str | Column], key: str, name: str) -> DataFrame:
    """(key, name): the place of each row, from 1, in the global order of ``keys``, which must tell all rows apart."""
    scan = OrderedScan(df, keys)
    place = df.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, Any] | None:
        n = sum(b.num_rows for b in batches)
        return {"n": n} if n else None

    offsets, before = {}, 0
    for pid, part in scan.summaries(count, "n long").items():
        offsets[pid] = before
        before += part["n"]

    def number(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = offsets.get(pid, 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(place), pa.array(range(at + 1, at + b.num_rows + 1), pa.int64())], names=[key, name])
            at += b.num_rows

    return scan.rescan(number, f"{key} {dict(df.dtypes)[key]}, {name} long")
