from __future__ import annotations

import json

import pytest

from measura import api, cli
from measura.config import EngineConfig, describe
from measura.sources import midi, sinks
from measura.sources.files import acquired, listing, sidecars


def test_config_checks_ranges():
    assert EngineConfig(tuning="drop-d").pitches()[0] == 38
    assert EngineConfig().merged(max_fret=24, model=None).max_fret == 24
    for bad in ({"max_fret": 11}, {"tuning": (1, 2, 3)}, {"tuning": (40, 40, 50, 55, 59, 64)}, {"lyrics": "guess"}, {"least_confidence": 1.1}, {"max_duration_s": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert {o["name"] for o in describe()} >= {"tuning", "max_fret"}


def test_cli(capsys):
    assert cli.main(["list"]) == 0 and "j1_cue_at" in capsys.readouterr().out.split()
    assert cli.main(["options"]) == 0 and json.loads(capsys.readouterr().out)
    assert cli.main(["run", "no_such_query", "/nowhere"]) == 2
    assert cli.main(["--registry", "measura.plans.registry", "list"]) == 0


def test_tab_and_state(spark):
    notes = spark.createDataFrame([(1, 1, 1.0, 1.8, 40, 0.9), (1, 2, 1.02, 1.7, 47, 0.8), (1, 3, 2.0, 2.5, 52, 0.95), (1, 4, 3.0, 3.1, 20, 0.9), (1, 5, 4.0, 4.1, 45, 0.1)], "run_id long, note_id long, start double, end double, pitch int, confidence double")
    tab = sorted((r.anchor, r.string, r.fret) for r in api.infer_tab(notes).collect())
    assert tab[:2] == [(1.0, 0, 0), (1.0, 1, 2)] and len(tab) == 3
    probes = spark.createDataFrame([(1, 0.5), (1, 1.5), (1, 1.9), (1, 9.0)], "run_id long, t double")
    got = api.state_at(probes, notes, "run_id", event_id="note_id").orderBy("t").collect()
    assert [r.note_id for r in got] == [None, 2, None, None]


def test_resumed_work(spark):
    wanted = spark.createDataFrame([(1, "lyrics", "a"), (1, "export", "b")], "p long, stage string, source string")
    first = api.work_left(wanted, spark.createDataFrame([], "p long, stage string, fingerprint string, status string"), "p", "source")
    assert first.count() == 2
    from pyspark.sql import functions as F

    done = first.where("stage = 'lyrics'").select("p", "stage", "fingerprint", F.lit("done").alias("status"))
    assert [r.stage for r in api.work_left(wanted, done, "p", "source").collect()] == ["export"]


def test_midi_source(spark, tmp_path):
    track = bytes([0, 0xFF, 0x03, 1, 65, 0, 0x90, 40, 90, 0x60, 47, 80, 0x10, 40, 0, 0, 0xC0, 5, 0, 0x91, 52, 1, 0, 0xFF, 0x2F, 0])
    data = b"MThd" + (6).to_bytes(4, "big") + bytes([0, 0, 0, 1, 0, 96]) + b"MTrk" + len(track).to_bytes(4, "big") + track
    (tmp_path / "a.mid").write_bytes(data)
    midi.register(spark)
    rows = spark.read.format("midi").load(str(tmp_path)).collect()
    assert [(r.tick, r.channel, r.pitch) for r in rows] == [(0, 0, 40), (96, 0, 47), (112, 1, 52)]
    for bad in (b"", b"RIFF", data[:-5] + b"\x90"):
        with pytest.raises(midi.MidiError):
            list(midi.note_starts(bad))


def test_sinks(spark, tmp_path):
    cues = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 1.0, 2.0, "b")], "doc long, start double, end double, text string")
    with pytest.raises(ValueError):
        sinks.write_lyrics(cues, str(tmp_path / "x"), "doc", "s", "en", "guessed")
    with pytest.raises(ValueError):
        sinks.write_lyrics(cues, str(tmp_path / "x"), "doc", "s", "en", "authored", alignment=cues)
    sinks.write_lyrics(cues, str(tmp_path / "l"), "doc", "s", "en", "measured")
    assert [c.text for c in spark.read.json(str(tmp_path / "l")).first().cues] == ["a", "b"]
    pos = spark.createDataFrame([(1, 0.5, 0, 3, 43)], "run long, anchor double, string int, fret int, pitch int")
    sinks.write_tab(pos, str(tmp_path / "t"), "run", "anchor", (40, 45, 50, 55, 59, 64), 20)
    assert spark.read.json(str(tmp_path / "t")).first().n_events == 1
    left_out = spark.createDataFrame([(1, 4)], "run long, omitted long")
    sinks.write_tab(pos, str(tmp_path / "t"), "run", "anchor", (40, 45, 50, 55, 59, 64), 20, left_out)
    assert spark.read.json(str(tmp_path / "t")).first().omitted_notes == 4
    assert [tuple(r) for r in sinks.read_tabs(spark, str(tmp_path / "t"), "run").collect()] == [(1, 0.5, 0, 3, 43, None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"run": 2, "events": [{"start": 0.5, "positions": [{"string": 0, "fret": 3, "pitch": 44}]}], "n_events": 1, "tuning": {"midi": [40], "max_fret": 20}}\n{"run": 3}\nnot json\n')
    assert sorted(r.reject for r in sinks.read_tabs(spark, str(tmp_path / "bad"), "run").collect()) == ["incomplete", "incomplete", "unsound position"]
    rec = spark.createDataFrame([(1, "lyrics", "done"), (1, "export", "done")], "p long, stage string, status string")
    sinks.save_ledger(rec, str(tmp_path / "g"))
    sinks.save_ledger(rec.where("stage = 'lyrics'").withColumn("p", rec.p + 1), str(tmp_path / "g"))
    assert sorted((r.p, r.stage) for r in spark.read.parquet(str(tmp_path / "g")).collect()) == [(1, "export"), (2, "lyrics")]


def test_stages_resume_where_they_have_to(spark, tmp_path):
    calls = []

    def stage(name):
        def run(keys, folder):
            calls.append((name, sorted(r.p for r in keys.collect())))
            return keys.withColumn("made", keys.p * 10)

        return run

    stages = {n: stage(n) for n in ("lyrics", "tab")}
    inputs = spark.createDataFrame([(1, "a"), (2, "b")], "p long, source string")
    assert api.run_stages(spark, inputs, "p", stages, str(tmp_path)) == ["lyrics", "tab"]
    assert api.run_stages(spark, inputs, "p", stages, str(tmp_path)) == []
    changed = spark.createDataFrame([(1, "a"), (2, "new"), (3, "c")], "p long, source string")
    assert api.run_stages(spark, changed, "p", stages, str(tmp_path)) == ["lyrics", "tab"]
    assert calls == [("lyrics", [1, 2]), ("tab", [1, 2]), ("lyrics", [2, 3]), ("tab", [2, 3])]
    assert sorted(r.p for r in spark.read.parquet(str(tmp_path / "tab")).collect()) == [1, 2, 3]


def test_corrections_of_the_right_revision(spark):
    base = spark.createDataFrame([(1, "r1", "a"), (2, "r1", "b"), (3, "r2", "c")], "k long, rev string, text string")
    edits = spark.createDataFrame([(1, "r1", "A", 1), (1, "r1", "AA", 2), (3, "r1", "stale", 9), (2, "r1", None, 5)], "k long, rev string, text string, at int")
    got = {r.k: (r.text, r.corrected) for r in api.corrected(base, edits, ["k"], "rev", "text", "at").collect()}
    assert got == {1: ("AA", True), 2: (None, True), 3: ("c", False)}


def test_files_are_listed_taken_and_ranked(spark, tmp_path):
    for name, data in (("a/song.mp3", b"xx"), ("a/song.de.lrc", b"[00:01.00] la"), ("a/song.en-US.lrc", b"[00:01.00] la"), ("a/other.flac", b"y" * 50), ("a/other.lrc", b"x"), ("b/alone.mp3", b"z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = listing(spark, str(tmp_path))
    best = {r.media.rpartition("/")[2]: (r.lyrics.rpartition("/")[2], r["rank"]) for r in sidecars(files, "en").collect()}
    assert best == {"song.mp3": ("song.en-US.lrc", 1), "other.flac": ("other.lrc", 0)}
    got = {r.path.rpartition("/")[2]: (r.sha256 is not None, r.reject) for r in acquired(spark, str(tmp_path), 40).collect()}
    assert got["other.flac"] == (False, "too large") and got["song.mp3"] == (True, None)
