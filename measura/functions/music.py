"""Pitches, strings, chords and the geometry of a neck, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note names, tunings, string gauges and chord templates.
PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
TUNINGS = {"standard": (40, 45, 50, 55, 59, 64), "drop-d": (38, 45, 50, 55, 59, 64), "dadgad": (38, 45, 50, 55, 57, 62)}
GAUGES = (0.046, 0.036, 0.026, 0.017, 0.013, 0.010)
CHORD_TEMPLATES = (
    ((0, 4, 7), ""), ((0, 3, 7), "m"), ((0, 4, 7, 10), "7"), ((0, 3, 7, 10), "m7"), ((0, 4, 7, 11), "maj7"),
    ((0, 4, 7, 9), "6"), ((0, 3, 7, 9), "m6"), ((0, 5, 7), "sus4"), ((0, 2, 7), "sus2"), ((0, 2, 4, 7), "add9"),
    ((0, 2, 3, 7), "madd9"), ((0, 3, 6), "dim"), ((0, 4, 8), "aug"), ((0, 3, 6, 10), "m7b5"), ((0, 3, 6, 9), "dim7"),
)
INLAYS_SINGLE, INLAYS_DOUBLE = (3, 5, 7, 9, 15, 17, 19, 21), (12, 24)


def template_masks() -> list[tuple[int, int, str]]:
    """(12-bit interval mask, rank, suffix) of each chord template."""
    return [(sum(1 << i for i in intervals), rank, suffix) for rank, (intervals, suffix) in enumerate(CHORD_TEMPLATES, 1)]


def names() -> Column:
    return F.array(*(F.lit(n) for n in PITCH_CLASSES))


def class_name(pc: Column) -> Column:
    return F.element_at(names(), (pc % 12).cast("int") + 1)


def chord_name(pitches: Column) -> Column:
    """Name of the chord of MIDI pitches (an array of at most six in 0..127), or null.

    Dyads are named only as fifths or fourths; three or four classes must equal a template; the bass
    as root wins, then the rank of the template, then the lowest root. A null array gives null.
    """
    classes = F.array_sort(F.array_distinct(F.transform(pitches, lambda p: p % 12)))
    bass = F.array_min(pitches) % 12
    ranks = F.create_map(*[F.lit(x) for m, r, _ in template_masks() for x in (m, r)])
    suffixes = F.array(*(F.lit(s) for _, _, s in template_masks()))
    mask = lambda root: F.aggregate(classes, F.lit(0), lambda acc, p: acc.bitwiseOR(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), (p - root + 12) % 12).cast("int")))
    matches = F.filter(F.transform(classes, lambda root: F.struct((root != bass).cast("int").alias("off"), F.try_element_at(ranks, mask(root)).alias("rank"), root.alias("root"))), lambda m: m["rank"].isNotNull())
    best = F.array_min(matches)
    slash = lambda root: F.when(root != bass, F.concat(F.lit("/"), class_name(bass))).otherwise("")
    a, b = F.element_at(classes, 1), F.element_at(classes, -1)
    fifth = F.when((b - a) == 7, a).when((b - a) == 5, b)
    dyad = F.concat(class_name(fifth), F.lit("5"), slash(fifth))
    full = F.concat(class_name(best["root"]), F.element_at(suffixes, best["rank"]), slash(best["root"]))
    fine = (F.size(pitches) <= 6) & F.forall(pitches, lambda p: p.between(0, 127))
    n = F.size(classes)
    return F.when(fine & (n == 2) & (b - a).isin(5, 7), dyad).when(fine & n.between(3, 4) & (F.size(matches) > 0), full)


def fret_position(n: Column) -> Column:
    """Distance of fret ``n`` from the nut, as a share of the scale; -1 for a negative fret."""
    return F.when(n < 0, F.lit(-1.0)).otherwise(1 - F.pow(F.lit(2.0), -n / 12))


def cell_centre(n: Column) -> Column:
    """Middle of the space behind fret ``n``; 0 for the open string, -1 for a negative fret."""
    return F.when(n < 0, F.lit(-1.0)).when(n == 0, F.lit(0.0)).otherwise((fret_position(n - 1) + fret_position(n)) / 2)


def inlay(n: Column) -> Column:
    return F.when(n.isin(*INLAYS_DOUBLE), 2).when(n.isin(*INLAYS_SINGLE), 1).otherwise(0)


def roman(n: Column, most: int = 24) -> Column:
    """Roman numeral of a fret in 1..most, its digits beyond."""

    def numeral(k: int) -> str:
        out = ""
        for value, sign in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out += sign * (k // value)
            k %= value
        return out

    table = F.array(*(F.lit(numeral(k)) for k in range(1, most + 1)))
    return F.when(n.between(1, most), F.try_element_at(table, n.cast("int"))).otherwise(n.cast("string"))
