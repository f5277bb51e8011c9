"""Standard MIDI files as a Spark data source: one row for each note that starts."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class MidiError(ValueError):
    pass


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and where it ends."""
    out = 0
    for _ in range(4):
        byte = data[at]
        at += 1
        out = out << 7 | byte & 0x7F
        if byte < 0x80:
            return out, at
    raise MidiError("a number runs too long")


def note_starts(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(track, tick, channel, pitch, velocity) of every note-on with a velocity above 0."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise MidiError("not a MIDI file")
    at, track = 8 + int.from_bytes(data[4:8], "big"), 0
    try:
        while at + 8 <= len(data):
            kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
            at, end = at + 8, at + 8 + size
            if kind == b"MTrk":
                tick, status, i = 0, 0, at
                while i < end:
                    step, i = _number(data, i)
                    tick += step
                    if data[i] >= 0x80:
                        status, i = data[i], i + 1
                    if status == 0xFF:
                        size, i = _number(data, i + 1)
                        i += size
                    elif status in (0xF0, 0xF7):
                        size, i = _number(data, i)
                        i += size
                    elif status >= 0x80:
                        if status & 0xF0 == 0x90 and data[i + 1]:
                            yield track, tick, status & 0x0F, data[i], data[i + 1]
                        i += 1 if status & 0xE0 == 0xC0 else 2
                    else:
                        raise MidiError("data without a status")
                track += 1
            at = end
    except IndexError as e:
        raise MidiError("the file ends early") from e


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        names = sorted(glob.glob(os.path.join(self.path, "*.mid"))) if os.path.isdir(self.path) else [self.path]
        return [_File(n) for n in names]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        for row in note_starts(data):
            yield (os.path.basename(partition.path), *row)


class MidiDataSource(DataSource):
    """``spark.read.format("midi").load(file or folder)``."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return "file string, track int, tick int, channel int, pitch int, velocity int"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MidiDataSource)
