"""Queries that once left part of their rows out, against brute force over small tables that hold such rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from test_operators import _slow_distance

from measura.operators import alignment as A
from measura.plans import registry

QUERIES = registry.collect()[0]


@pytest.fixture
def tables(spark, tmp_path):
    """Writes (name, schema, rows) as the tables of a data folder and gives the folder."""

    def write(**given) -> str:
        for name, (schema, rows) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


CUES = "cue_id long, attempt_id long, start_s double, end_s double, text string, avg_logprob double"


def _similar(a: str, b: str) -> float:
    a, b = a[:32], b[:32]
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return 1.0 if a == b else 0.75 * (1 - _slow_distance(a, b) / max(len(a), len(b))) + 0.5 * p / (len(a) + len(b))


def test_pairs_hold_lines_of_all_scripts(spark, tables):
    lines = ["We kept the kite", "Où est le café ?", "We kept the kites", "Мы шли домой", "Мы шли домой поздно", "星の夜", "It’s raining", "straße"]
    d = tables(raw_cues=(CUES, [(i, 1, float(i), i + 1.0, t, -0.1) for i, t in enumerate(lines)]))
    pairs = {i: (a, b) for i, (a, b) in enumerate(zip(lines, lines[1:], strict=False), 1)}
    got = {name: {r.cue_id: r for r in QUERIES[name](spark, d).collect()} for name in ("h6_levenshtein", "h7_similarity", "h8_letter_mask", "h9_pair_score", "h10_line_rules")}
    for rows in got.values():
        assert set(rows) == set(pairs)
    for i, (a, b) in pairs.items():
        assert got["h6_levenshtein"][i].distance == _slow_distance(a, b)
        assert got["h7_similarity"][i].similarity == pytest.approx(_similar(a, b), abs=1e-6)
        assert got["h9_pair_score"][i].score == pytest.approx(4.4 * (_similar(a, b) - 0.5) - 1.2, abs=1e-5)
        mask = 0
        for c in b:
            mask |= 1 << ord(c) % 63
        assert got["h8_letter_mask"][i].mask == mask
    assert [i for i, r in got["h10_line_rules"].items() if r.extends] == [4]


def test_cues_are_clipped_to_their_own_song(spark, tables):
    cues = [(1, 1, 10.0, 12.0), (2, 1, 150.0, 190.0), (3, 1, 180.0, 185.0), (4, 2, 70.0, 75.0), (5, 2, 59.0, 63.0), (6, 3, 500.0, 501.0), (7, 4, 500.0, 500.01), (8, 9, 130.0, 131.0)]
    d = tables(
        raw_cues=(CUES, [(*c, "la", -0.1) for c in cues]),
        attempts=("attempt_id long, song_id long", [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4)]),
        media_metadata=("song_id long, duration double", [(1, 180.0), (1, 180.0), (2, 60.0), (3, None), (4, 0.0)]),
    )
    got = {r.cue_id: (r.start, r.end) for r in QUERIES["b4_clean_cues"](spark, d).collect()}
    assert got == {1: (10.0, 12.0), 2: (150.0, 180.0), 5: (59.0, 60.0), 6: (500.0, 501.0), 7: (500.0, 500.05), 8: (130.0, 131.0)}


def test_twelve_of_a_run_are_kept(spark, tables):
    texts = ["La la"] * 15 + ["so", "La la", " la LA "]
    d = tables(raw_cues=(CUES, [(i, 1, float(i), i + 1.0, t, -0.1) for i, t in enumerate(texts)]))
    assert sorted(r.cue_id for r in QUERIES["e6_cap_runs"](spark, d).collect()) == [*range(12), 15, 16, 17]


def test_library_places_are_global(spark, tables):
    rng = random.Random(5)
    seen = [(i, datetime(2025, 1, 1) + timedelta(hours=rng.randrange(40))) for i in range(1, 301)] + [(301, None)]
    d = tables(media_metadata=("song_id long, scanned_at timestamp", [*seen, (7, datetime(2026, 1, 1))]))
    latest = {**dict(seen), 7: datetime(2026, 1, 1)}
    order = sorted(latest, key=lambda i: (latest[i] is None, -latest[i].timestamp() if latest[i] else 0, i))
    assert {r.song_id: r.place for r in QUERIES["a35_library"](spark, d).collect()} == {i: n for n, i in enumerate(order, 1)}


def test_every_sheet_and_every_attempt_is_aligned(spark, tables):
    """A song's attempts meet its best sheet, its sheets its best attempt: no product of both."""
    sheets = [(1, 1, "the river runs past the tin roof"), (2, 1, "[00:01.00] a paper kite in the sun\n[00:02.00] and a river"), (3, 2, "le café bleu"), (4, 3, "nobody sang this"), (5, 1, " ")]
    cues = [(1, 11, 0.0, 1.0, "the rivers run"), (2, 11, 1.0, 2.0, "past a tin roof"), (3, 12, 0.0, 2.0, "paper kites in the sun"), (4, 21, 0.0, 1.0, "le café")]
    attempts = [(11, 1), (12, 1), (12, 1), (13, 1), (21, 2), (41, 4)]
    many = 70
    sheets += [(100 + i, 5, f"the tin roof number {i}") for i in range(many)]
    attempts += [(100 + i, 5) for i in range(many)]
    cues += [(100 + i, 100 + i, 0.0, 1.0, f"a tin proof number {i}") for i in range(many)]
    word = "word_id long, cue_id long, attempt_id long, word_ix int, start_s double, end_s double, text string"
    d = tables(
        embedded_lyrics=("lyrics_id long, song_id long, tag string, origin string, language_code string, text string", [(i, s, "LYRICS", "tag", "en", t) for i, s, t in [*sheets, sheets[0]]]),
        attempts=("attempt_id long, song_id long", attempts), raw_cues=(CUES, [(*c, -0.1) for c in cues]),
        lyric_words=(word, [(1, 3, 12, 0, 0.5, 1.0, "paper"), (2, 3, 12, 1, 1.0, 1.5, "kite")]), media_metadata=("song_id long, duration double", [(1, 9.0), (1, 9.0), (2, None), (5, 4.0)]),
    )
    best_sheet = {r.song_id: r.lyrics_id for r in QUERIES["f4_best_sheet"](spark, d).collect()}
    best_attempt = {r.song_id: r.attempt_id for r in QUERIES["d10_choose_attempt"](spark, d).collect()}
    got = {(r.lyrics_id, r.attempt_id): r.asDict() for r in QUERIES["j13_alignment"](spark, d).collect()}
    texts, own = {i: t for i, _, t in sheets}, {12: [(0.5, 1.0, "paper"), (1.0, 1.5, "kite")]}
    want = {(best_sheet[s], a) for a, s in attempts if s in best_sheet} | {(i, best_attempt[s]) for i, s, t in sheets if s in best_attempt and t.strip()}
    assert set(got) == want and len(want) == 4 + 1 + 2 * many - 1
    for (lyrics, attempt), r in got.items():
        heard = A.heard_words([(*c[2:], own.get(attempt)) for c in cues if c[1] == attempt])
        _, figures = A.aligned(texts[lyrics].replace("[00:01.00]", " ").replace("[00:02.00]", " ").splitlines(), heard, {1: 9.0, 5: 4.0}.get(r["song_id"]))
        assert {k: r[k] for k in figures} == figures
    assert sum(r.alignments for r in QUERIES["d12_grades"](spark, d).collect()) == len(got)
    times = QUERIES["e11_word_times"](spark, d).where("lyrics_id = 3").orderBy("place").collect()
    assert [(r.word, r.origin) for r in times] == [("le", "matched"), ("café", "matched"), ("bleu", "interpolated")]


def test_the_best_of_all_attempts_is_kept(spark, tables):
    spans = {1: (10.0, -0.5), 2: (9.0, -0.5), 3: (9.5, -0.3), 4: (30.0, -0.9), 5: (29.0, -0.87), 7: (4.0, -0.1), 8: (4.0, -0.2)}
    songs = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 3, 9: 4}
    d = tables(attempts=("attempt_id long, song_id long", list(songs.items())), raw_cues=(CUES, [(a, a, 0.0, s, "la", p) for a, (s, p) in spans.items()]))
    got = {r.song_id: (r.attempt_id, r.reason) for r in QUERIES["d10_choose_attempt"](spark, d).collect()}
    assert got == {1: (4, "tie"), 2: (7, "empty"), 3: (8, "single"), 4: (9, "single")}
