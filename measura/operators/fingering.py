"""Strings and frets for chords: the cheapest path through the candidate shapes of each run."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from measura.functions.music import TUNINGS

# Costs of a shape and of a move between shapes, limits of a hand.
SPAN_COST, HAND_COST, SKIP_COST, OPEN_COST, SHIFT_COST, STRING_COST = 1.7, 0.055, 0.2, 0.05, 0.85, 0.18
WIDEST_SPAN, MOST_SHAPES = 5, 192

Shape = tuple[tuple[int, int, int], ...]  # (string, fret, pitch), by string


def shapes(pitches: Sequence[int], tuning: Sequence[int] = TUNINGS["standard"], max_fret: int = 20) -> list[tuple[float, float, Shape]]:
    """(cost, hand, shape) of every way to play all pitches at once, one string each, within the span of a hand."""
    found: list[tuple[float, float, Shape]] = []

    def grow(left: Sequence[int], used: int, low: int, high: int, taken: list[tuple[int, int, int]]) -> None:
        if not left:
            frets = [f for _, f, _ in taken if f]
            hand = float(median(frets)) if frets else 0.0
            strings = sorted(s for s, _, _ in taken)
            skipped = strings[-1] - strings[0] + 1 - len(strings)
            span = high - low if frets else 0
            cost = span * SPAN_COST + hand * HAND_COST + skipped * SKIP_COST + (len(taken) - len(frets)) * OPEN_COST
            found.append((cost, hand, tuple(sorted(taken))))
            return
        for s, open_ in enumerate(tuning):
            f = left[0] - open_
            if used >> s & 1 or not 0 <= f <= max_fret:
                continue
            a, b = (min(low, f), max(high, f)) if f else (low, high)
            if b - a <= WIDEST_SPAN:
                grow(left[1:], used | 1 << s, a, b, [*taken, (s, f, left[0])])

    grow(list(pitches), 0, 10**6, -(10**6), [])
    return found


def best_shapes(pitches: Sequence[int], confidence: dict[int, float], tuning: Sequence[int] = TUNINGS["standard"], max_fret: int = 20, most: int | None = None) -> list[tuple[float, float, Shape]]:
    """The cheapest shapes of the largest playable subset of the ``most`` highest pitches (one a string), the most confident where several are as large."""
    most = most or len(tuning)
    within = [p for p in sorted(pitches) if any(0 <= p - t <= max_fret for t in tuning)][-most:]
    for size in range(min(len(within), len(tuning)), 0, -1):
        by_strength: dict[float, list] = {}
        for some in combinations(within, size):
            if made := shapes(some, tuning, max_fret):
                by_strength.setdefault(sum(confidence.get(p, 1.0) for p in some), []).extend(made)
        if by_strength:
            return sorted(by_strength[max(by_strength)])[:MOST_SHAPES]
    return []


def cheapest_path(layers: Sequence[Sequence[tuple[float, float, Shape]]]) -> list[int]:
    """Index of the shape to take in each layer: least total of shape costs and moves; the lowest index on a tie."""
    if not layers:
        return []
    total = np.array([c for c, _, _ in layers[0]])
    back: list[np.ndarray] = []
    for before, now in zip(layers, layers[1:], strict=False):
        hand_a, hand_b = np.array([h for _, h, _ in before]), np.array([h for _, h, _ in now])
        move = np.abs(hand_a[:, None] - hand_b[None, :]) * SHIFT_COST
        held = {p for _, _, s in before for _, _, p in s} & {p for _, _, s in now for _, _, p in s}
        for p in held:
            at = lambda layer, p=p: np.array([next((s for s, _, q in shape if q == p), -99) for _, _, shape in layer])
            a, b = at(before), at(now)
            both = (a[:, None] >= 0) & (b[None, :] >= 0)
            move += np.where(both, np.abs(a[:, None] - b[None, :]), 0) * STRING_COST
        ways = total[:, None] + move
        back.append(ways.argmin(axis=0))
        total = ways.min(axis=0) + np.array([c for c, _, _ in now])
    path = [int(total.argmin())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def fingerings(chosen: DataFrame, key: str, group: str, tuning: Sequence[int] = TUNINGS["standard"], max_fret: int = 20) -> DataFrame:
    """(key, group, string, fret, pitch) for the selected notes (key, group, pitch, confidence): one path for each key.

    The path is sequential, so a run is worked through in one task; a run is one transcription of
    one song. Pitches that no shape can hold are left out. The shapes of a chord are found once in a run.
    """
    types = dict(chosen.dtypes)

    def play(run: pd.DataFrame) -> pd.DataFrame:
        layers, at, met = [], [], {}
        for g, rows in run.sort_values([group, "pitch"]).groupby(group, sort=True):
            chord = tuple(zip(rows["pitch"].tolist(), rows["confidence"].tolist(), strict=True))
            if chord not in met:
                met[chord] = best_shapes([p for p, _ in chord], dict(chord), tuning, max_fret)
            if met[chord]:
                layers.append(met[chord])
                at.append(g)
        out = [(run[key].iloc[0], g, s, f, p) for g, layer, i in zip(at, layers, cheapest_path(layers), strict=True) for s, f, p in layer[i][2]]
        return pd.DataFrame(out, columns=[key, group, "string", "fret", "pitch"])

    return chosen.select(key, group, "pitch", "confidence").groupBy(key).applyInPandas(lambda run: play(run), f"{key} {types[key]}, {group} {types[group]}, string int, fret int, pitch int")
