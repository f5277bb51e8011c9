from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from measura.functions import music as M
from measura.functions import text as X
from measura.operators import alignment as A
from measura.operators import interval_joins as J
from measura.operators import notes as N
from measura.operators.fingering import best_shapes, cheapest_path, shapes

CHORDS = {(48, 52, 55): "C", (45, 48, 52): "Am", (48, 55, 60): "C5", (50, 55, 60): "Gsus4/D", (48, 53, 57, 60, 65, 72): "F/C", (60, 64, 67, 69): "C6", (60, 64, 68): "Caug", (54, 60): None, (60, 61, 64, 67): None, (60, 72): None, (52, 55, 60): "C/E", (40, 47): "E5", (53, 58): "A#5/F", (48, 52, 55, 71): "Cmaj7", (46, 53, 58, 60, 62, 70): "A#add9", (57, 60, 64, 67): "Am7", (48, 52): None, (50, 60, 69): None, (60, 64, 67, 71, 74): None, (40, 41, 42): None}


def test_chord_names(spark):
    df = spark.createDataFrame([(list(p),) for p in CHORDS], "p array<int>")
    got = [r[0] for r in df.select(M.chord_name(F.col("p"))).collect()]
    assert dict(zip(CHORDS, got, strict=True)) == CHORDS


def _notes(spark, rows):
    return spark.createDataFrame([(1, i, float(s), float(e), p, float(c)) for i, (s, e, p, c) in enumerate(rows)], "run_id long, note_id long, start double, end double, pitch int, confidence double")


def test_restart_merge_joins_within_the_gap(spark):
    got = N.restart_merge(_notes(spark, [(0, 0.4, 55, 0.8), (0.5, 1.2, 55, 0.6), (2, 3, 55, 0.7)]), "run_id").orderBy("start").collect()
    assert [(r.start, r.end, r.confidence, r.merged) for r in got] == [(0.0, 1.2, 0.8, 2), (2.0, 3.0, 0.7, 1)]


def test_onset_groups_are_anchored(spark):
    rng = random.Random(3)
    starts = sorted(round(rng.random() * 3, 3) for _ in range(120))
    anchors, anchor = [], None
    for s in starts:
        if anchor is None or s - anchor > 0.09:
            anchor = s
        anchors.append(anchor)
    got = N.onset_groups(_notes(spark, [(s, s + 1, 40 + i % 20, 0.9) for i, s in enumerate(starts)]), "run_id").orderBy("note_id").collect()
    assert [r.anchor for r in got] == anchors


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(1)
    mk = lambda n: [(rng.choice("ab"), i, s := rng.random() * 50, s + rng.random() * 9) for i in range(n)]
    left, right = mk(60), mk(60)
    a = spark.createDataFrame(left, "k string, i long, s double, e double")
    b = spark.createDataFrame(right, "k string, j long, s2 double, e2 double")
    got = {(r.i, r.j) for r in J.overlap_join(a, b, "k", ("s", "e"), ("s2", "e2"), 4.0).collect()}
    assert got == {(x[1], y[1]) for x in left for y in right if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])}


def test_as_of_and_next_of_against_all_pairs(spark):
    rng = random.Random(8)
    events = [(rng.choice("ab"), i, round(rng.random() * 400, 1)) for i in range(120)]
    probes = [(rng.choice("abc"), round(rng.random() * 500 - 20, 1)) for _ in range(150)]
    e = spark.createDataFrame(events, "k string, i long, s double")
    p = spark.createDataFrame(probes, "k string, t double")
    for width in (3.0, 50.0, 1e6):
        back = sorted((r.k, r.t, r.i if r.i is not None else -1) for r in J.as_of(p, e, "k", "t", "s", "i", ["i"], width).collect())
        ahead = sorted((r.k, r.t, r.i if r.i is not None else -1) for r in J.next_of(p, e, "k", "t", "s", "i", ["i"], width).collect())
        assert back == sorted((k, t, max(((s, i) for x, i, s in events if x == k and s <= t), default=(0, -1))[1]) for k, t in probes)
        assert ahead == sorted((k, t, min(((s, i) for x, i, s in events if x == k and s > t), default=(0, -1))[1]) for k, t in probes)


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.clock_text(F.lit(59.9996))) == "01:00.000"
    assert one(X.clock_seconds(F.lit("1:02:03,5"))) == 3723.5
    assert one(X.file_size(F.lit("512M"))) == 512 * 1024**2
    assert one(X.url_verdict(F.lit("https://youtu.be/abc?list=PL1"))) == "ok"
    assert one(X.url_verdict(F.lit("https://youtube.com/embed/videoseries?list=PL1"))) == "playlist"
    assert one(X.folded(F.lit("L’Été, déjà!"))) == "l ete deja"
    assert X.number_words("1985") == ["nineteen", "eighty", "five"]
    assert X.number_words("2000") == ["two", "thousand"]


def _slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def _slow_similarity(a, b):
    if a == b:
        return 1.0
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    s = 0.75 * (1 - _slow_distance(a, b) / max(len(a), len(b))) + 0.5 * p / (len(a) + len(b))
    return s if s >= 0.5 else 0.0


def test_similarities_against_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    got = A.similarities(words, words[::-1])
    for i, x in enumerate(words):
        for j, y in enumerate(words[::-1]):
            assert got[i, j] == pytest.approx(_slow_similarity(x, y), abs=1e-9)


def test_alignment_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.choice(["run", "sun", "river", "rivers", "tin", "roof"]) for _ in range(rng.randint(0, 9))]
        b = [rng.choice(["run", "sun", "river", "rivets", "tin", "proof"]) for _ in range(rng.randint(0, 9))]
        sc = lambda x, y: 2 * A.GAP + A.MATCH_SCALE * (s - 0.5) if (s := _slow_similarity(x, y)) else 4 * A.GAP
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = []
                if i:
                    ways.append(best[i - 1][j] + A.GAP)
                if j:
                    ways.append(best[i][j - 1] + A.GAP)
                if i and j:
                    ways.append(best[i - 1][j - 1] + sc(a[i - 1], b[j - 1]))
                best[i][j] = max(ways, default=0.0)
        pairs = A.align(a, b)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        total = sum(sc(a[i], b[j]) for i, j in pairs) + A.GAP * (len(a) + len(b) - 2 * len(pairs))
        assert total == pytest.approx(best[len(a)][len(b)], abs=1e-4)


def test_fingering_paths():
    assert {s for _, _, s in shapes([40])} == {((0, 0, 40),)}
    assert best_shapes([20], {}) == []
    best = best_shapes([40, 41, 52, 59], {40: 0.9, 41: 0.6, 52: 0.9, 59: 0.9})
    assert {52, 59} <= {p for _, _, p in best[0][2]} and len(best[0][2]) == 3
    layers = [best_shapes([45], {}), best_shapes([52, 57], {}), best_shapes([64], {})]
    cost = lambda path: sum(layers[i][k][0] for i, k in enumerate(path)) + sum(abs(layers[i][a][1] - layers[i + 1][b][1]) * 0.85 for i, (a, b) in enumerate(zip(path, path[1:], strict=False)))
    from itertools import product

    every = [cost(p) for p in product(*(range(len(x)) for x in layers))]
    assert cost(cheapest_path(layers)) == pytest.approx(min(every))
