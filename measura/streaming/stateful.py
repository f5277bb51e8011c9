"""Structured Streaming forms of the stateful operators; each has a batch twin that the tests hold it against.

Event time is a TIMESTAMP. Results are final behind the watermark, which plays the part of the
clock of what has been heard: the latest time seen less a delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder, so many for each batch: a slow consumer holds the source back."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def density(events: DataFrame, key: str, ts: str, bucket: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events of each key in tumbling buckets. On a batch DataFrame the watermark has no effect: the twin."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(key, F.window(ts, bucket).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("bucket"), "n")


def sessions(events: DataFrame, key: str, ts: str, seconds: str, gap_s: float = 0.15, delay: str = "10 minutes") -> DataFrame:
    """Restart sessions: an event lasts ``seconds`` and the next joins within ``gap_s`` of its end (dynamic session gap)."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    gap = F.concat(F.round((F.col(seconds) + F.lit(gap_s)) * 1_000_000).cast("long").cast("string"), F.lit(" microseconds"))
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first")).select(key, "first", "n")


LATCH_STATE = "candidate string, since double, shown string"
LATCH_OUT = "label string, shown_at double"


class LabelLatch(StatefulProcessor):
    """A label shows once it has stood for ``hold`` seconds; ticks without a name change nothing, silence clears all.

    The input of a key comes as (t, label, silent); the state is the candidate, since when it
    stands and what is shown. Ticks of one batch are taken in the order of t.
    """

    def __init__(self, key: str, hold: float = 0.25):
        self.key, self.hold = key, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latch", LATCH_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ticks = pd.concat(list(rows)).sort_values("t")
        candidate, since, shown = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for t, label, silent in ticks[["t", "label", "silent"]].itertuples(index=False, name=None):
            if silent:
                candidate = since = shown = None
            elif isinstance(label, str):
                if label != candidate:
                    candidate, since = label, t
                if candidate != shown and t - since >= self.hold:
                    shown = candidate
                    out.append((key[0], label, float(t)))
        self.state.update((candidate, since, shown))
        yield pd.DataFrame(out, columns=[self.key, "label", "shown_at"])

    def close(self) -> None:
        pass


def latch(ticks: DataFrame, key: str, hold: float = 0.25) -> DataFrame:
    """(key, label, shown_at) of a stream of (key, t DOUBLE, label, silent); needs the RocksDB state store."""
    kind = dict(ticks.dtypes)[key]
    return ticks.groupBy(key).transformWithStateInPandas(statefulProcessor=LabelLatch(key, hold), outputStructType=f"{key} {kind}, {LATCH_OUT}", outputMode="Append", timeMode="None")


def latch_rows(rows: list[tuple[float, str | None, bool]], hold: float = 0.25) -> list[tuple[str, float]]:
    """The twin of :func:`latch` on one key's ticks in order."""
    candidate = shown = None
    since, out = 0.0, []
    for t, label, silent in rows:
        if silent:
            candidate = shown = None
        elif label is not None:
            if label != candidate:
                candidate, since = label, t
            if candidate != shown and t - since >= hold:
                shown = candidate
                out.append((label, t))
    return out
