"""Order-preserving fuzzy alignment of a reference text with timed words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from measura.functions.speech import is_marker_line, tokens_of

# Gap and match scores, the least similarity of a pair, limits, and the grades.
GAP, MATCH_SCALE, LEAST_SIMILARITY, COMPARED = -0.6, 4.4, 0.5, 32
MOST_TOKENS, MOST_CELLS = 6000, 6_000_000
LEAST_WORD, LEAST_CUE, USUAL_RATE, RATES = 0.04, 0.05, 0.09, (0.02, 0.5)
#: word pairs that are compared at once
BLOCK_CELLS = 1_000_000
_SCALE = 1_000_000  # scores are whole millionths, so ties are exact


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int32)
    out = np.zeros((len(words), int(size.max(initial=1))), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out, size


def similarities(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Similarity of every left with every right word; 0 below one half. Edit distances run over all near pairs at once."""
    if not left or not right:
        return np.zeros((len(left), len(right)))
    a, n = _codes([w[:COMPARED] for w in left])
    b, m = _codes([w[:COMPARED] for w in right])
    if len(left) > 1 and len(left) * len(right) > BLOCK_CELLS:  # rows in blocks, so that memory stays bounded
        step = max(1, BLOCK_CELLS // len(right))
        return np.vstack([similarities(left[i : i + step], right) for i in range(0, len(left), step)])
    longest, total = np.maximum(n[:, None], m[None, :]), n[:, None] + m[None, :]
    same, prefix = np.ones(longest.shape, bool), np.zeros(longest.shape, np.int8)
    for k in range(min(a.shape[1], b.shape[1])):
        same &= (a[:, k, None] == b[None, :, k]) & (a[:, k, None] > 0)
        if not same.any():
            break
        prefix += same
    room = 0.25 * 2 * prefix / total
    # letters (of 64 kinds) that only one side has bound the distance from below
    mask = lambda codes, size: np.array([sum(1 << int(k) for k in set((row[:s] % 63).tolist())) for row, s in zip(codes, size, strict=True)], np.uint64)
    x, y = mask(a, n), mask(b, m)
    only = np.maximum(np.bitwise_count(x[:, None] & ~y[None, :]), np.bitwise_count(y[None, :] & ~x[:, None]))
    least = np.maximum(only, np.abs(n[:, None] - m[None, :]))
    hopeful = 0.75 * (1 - least / longest) + room >= LEAST_SIMILARITY
    i, j = np.nonzero(hopeful)
    row = np.tile(np.arange(b.shape[1] + 1, dtype=np.int16), (len(i), 1))
    done = row[np.arange(len(i)), m[j]].copy()
    for k in range(a.shape[1]):
        now = np.empty_like(row)
        now[:, 0] = k + 1
        for c in range(b.shape[1]):
            now[:, c + 1] = np.minimum(np.minimum(row[:, c + 1], now[:, c]) + 1, row[:, c] + (a[i, k] != b[j, c]))
        row = now
        ended = n[i] == k + 1
        done[ended] = row[ended, m[j[ended]]]
    out = np.zeros((len(left), len(right)))
    sim = 0.75 * (1 - done / longest[i, j]) + room[i, j]
    whole = np.array([left[p] == right[q] for p, q in zip(i, j, strict=True)], bool)
    sim = np.where(whole, 1.0, sim)
    out[i, j] = np.where(sim >= LEAST_SIMILARITY, sim, 0.0)
    return out


class TooLong(ValueError):
    """A text or recording beyond the limits of one alignment."""


def align(reference: Sequence[str], hypothesis: Sequence[str], most_tokens: int = MOST_TOKENS, most_cells: int = MOST_CELLS) -> list[tuple[int, int]]:
    """Pairs of the best global alignment; a match wins a tie over a skipped reference token, that over a skipped hypothesis token."""
    rows, columns = len(reference), len(hypothesis)
    if not rows or not columns:
        return []
    if max(rows, columns) > most_tokens or rows * columns > most_cells:
        raise TooLong("too long to align")
    left, right = sorted(set(reference)), sorted(set(hypothesis))
    sim = similarities(left, right)
    gap = round(GAP * _SCALE)
    score = np.where(sim > 0, np.rint((2 * GAP + MATCH_SCALE * (sim - 0.5)) * _SCALE), 4 * gap).astype(np.int64)
    at = {w: k for k, w in enumerate(right)}
    hyp = np.array([at[w] for w in hypothesis])
    of = {w: k for k, w in enumerate(left)}
    steps = np.arange(columns + 1, dtype=np.int64) * gap
    best = steps.copy()
    took = np.zeros((rows, columns + 1), np.int8)  # 0 match, 1 reference skipped, 2 hypothesis skipped
    for r, word in enumerate(reference):
        diagonal = np.full(columns + 1, np.iinfo(np.int64).min // 2)
        diagonal[1:] = best[:-1] + score[of[word]][hyp]
        above = best + gap
        down = np.maximum(diagonal, above)
        # skipping hypothesis tokens carries the best of the row to the right
        row = np.maximum.accumulate(down - steps) + steps
        took[r] = np.where(diagonal == row, 0, np.where(above == row, 1, 2))
        best = row
    pairs, r, c = [], rows, columns
    while r and c:
        way = took[r - 1, c]
        if way == 0:
            if sim[of[reference[r - 1]], at[hypothesis[c - 1]]] > 0:
                pairs.append((r - 1, c - 1))
            r, c = r - 1, c - 1
        elif way == 1:
            r -= 1
        else:
            c -= 1
    return pairs[::-1]


def grade(matched: float, displacement: float, run: int) -> str:
    if matched < 0.55 or displacement > 12 or run > 24:
        return "poor"
    return "good" if matched >= 0.85 and displacement <= 0.5 and run <= 8 else "fair"


def weight(word: str) -> int:
    """Letters and digits of a word, at least one."""
    return max(1, sum(map(str.isalnum, word)))


def laid_out(weights: Sequence[int], measured: Sequence[tuple[float, float] | None], duration: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """((word, start and end), worst error of each start) of a text of which some words are measured.

    A stretch between two measured words shares their distance by ``max(LEAST_WORD, weight * rate)``; one before the first or
    behind the last is laid out at the rate of the measured part, and narrowed to the time there is if its words have
    ``LEAST_WORD`` each. A last pass keeps the words from going backwards. The error of a start is its distance to the
    further end of the stretch that its word is known to lie in.
    """
    w = np.asarray(weights, float)
    n, known = len(w), [i for i, m in enumerate(measured) if m is not None]
    times, within = np.zeros((n, 2)), np.zeros((n, 2))
    if known:
        for i in known:
            times[i], within[i] = measured[i], measured[i][0]
        passed, sung = measured[known[-1]][1] - measured[known[0]][0], w[known[0] : known[-1] + 1].sum()
        rate = USUAL_RATE if len(known) < 2 or passed <= 0 else min(RATES[1], max(RATES[0], passed / sung))
        lengths = np.maximum(LEAST_WORD, w * rate)
    else:
        lengths = w
    for a, b in zip([-1, *known], [*known, n], strict=True):
        own = slice(a + 1, b)
        if b - a < 2:
            continue
        total, least = float(lengths[own].sum()), (b - a - 1) * LEAST_WORD
        left, right = measured[a][1] if a >= 0 else None, measured[b][0] if b < n else None
        if left is None and right is None:
            room = duration if duration is not None else max(total * USUAL_RATE, LEAST_CUE)
            at, scale, low, high = 0.0, room / total, 0.0, room
        elif left is None:
            scale = right / total if least <= right < total else 1.0
            at, low, high = max(0.0, right - total * scale), 0.0, right
        elif right is None:
            room = None if duration is None else duration - left
            scale = room / total if room is not None and least <= room < total else 1.0
            at, low, high = left, left, max(left + total * scale, duration or 0.0)
        else:
            room = max(0.0, right - left)
            at, scale, low, high = left, room / total, left, left + room
        ends = at + scale * np.cumsum(lengths[own])
        times[own, 0], times[own, 1] = np.r_[at, ends[:-1]], ends
        within[own] = low, high
    times = np.maximum.accumulate(np.maximum(times.reshape(-1), 0.0)).reshape(n, 2)
    return times, np.maximum(np.maximum(times[:, 0] - within[:, 0], within[:, 1] - times[:, 0]), 0.0)


def spread(start: float, end: float, text: str) -> list[tuple[float, float, str]]:
    """The words of a line that has no times of its own, spread inside its span by their weights."""
    pieces = text.split()
    shares = np.cumsum([0, *map(weight, pieces)])
    at = start + max(0.0, end - start) * shares / max(1, shares[-1])
    return [(round(float(a), 3), round(float(b), 3), p) for a, b, p in zip(at, at[1:], pieces, strict=False)]


def _sound(start: float | None, end: float | None, text: str | None) -> bool:
    return start is not None and end is not None and bool(text and text.strip()) and np.isfinite([start, end]).all() and start >= 0


def heard_words(cues: Iterable[tuple[float, float, str, Iterable[tuple[float, float, str]] | None]]) -> list[tuple[float, float, str]]:
    """Timed words of cues (start, end, text, words): their own where any is sound, else the text spread over the cue."""
    out: list[tuple[float, float, str]] = []
    for start, end, text, words in cues:
        if start is None or end is None or not np.isfinite([start, end]).all() or start < 0:
            continue
        own = [(s, max(s, e), t.strip()) for s, e, t in words or () if _sound(s, e, t)]
        out += own or spread(start, end, text or "")
    return out


def aligned(lines: Sequence[str], words: Sequence[tuple[float, float, str]], duration: float | None = None, **limits: int) -> tuple[list[tuple[int, str, float, float, str]], dict]:
    """([(line, word, start, end, origin)], report) of timing the words of a text by the words (start, end, text) heard.

    Lines that are blank or only name a part of the song are left out. A word is measured if any of its tokens is
    matched: ``matched`` if all those are equal, else ``near``; the others are ``interpolated``.
    """
    kept = [line.strip() for line in lines if line.strip()]
    sung = [line for line in kept if not is_marker_line(line)]
    text = [(i, w) for i, line in enumerate(sung) for w in line.split()]
    ref, owner = [], []
    for i, (_, w) in enumerate(text):
        for t in tokens_of(w):
            ref.append(t)
            owner.append(i)
    heard = sorted(((s, max(s, e), t) for s, e, t in words if _sound(s, e, t)), key=lambda w: w[:2])
    hyp, said_by = [], []
    for i, (_, _, w) in enumerate(heard):
        for t in tokens_of(w):
            hyp.append(t)
            said_by.append(i)
    pairs = align(ref, hyp, **limits)
    by_word: dict[int, list[int]] = {}
    unlike = set()
    for r, h in pairs:
        by_word.setdefault(owner[r], []).append(said_by[h])
        if ref[r] != hyp[h]:
            unlike.add(owner[r])
    measured = [(min(heard[h][0] for h in by_word[i]), max(heard[h][1] for h in by_word[i])) if i in by_word else None for i in range(len(text))]
    times, error = laid_out([weight(w) for _, w in text], measured, duration)
    origin = ["interpolated" if m is None else "near" if i in unlike else "matched" for i, m in enumerate(measured)]
    rows = [(line, w, round(float(a), 3), round(float(b), 3), o) for (line, w), (a, b), o in zip(text, times, origin, strict=True)]
    rows = _shown(rows)
    alignable = sorted(set(owner))
    unheard = np.array([measured[i] is None for i in alignable], int)
    cuts = np.flatnonzero(np.r_[0, unheard, 0] == 0)
    matched = int(len(unheard) - unheard.sum())
    n, exact = max(1, len(alignable)), matched - len(unlike)
    used = {h for hs in by_word.values() for h in hs}
    mean, longest = float(error[alignable].sum() / n), int(np.diff(cuts).max(initial=1)) - 1
    return rows, {
        "words": len(text), "alignable": len(alignable), "heard": len(heard), "ignored": len(words) - len(heard), "exact": exact, "near": len(unlike), "interpolated": len(text) - matched,
        "matched_fraction": round(matched / n, 4), "exact_fraction": round(exact / n, 4), "used_fraction": round(len(used) / len(heard), 4) if heard else 0.0,
        "mean_displacement": round(mean, 3), "longest_run": longest, "markers": len(kept) - len(sung), "grade": grade(matched / n, mean, longest),
    }


def _shown(rows: list[tuple[int, str, float, float, str]]) -> list[tuple[int, str, float, float, str]]:
    """``rows`` with each line shown for ``LEAST_CUE`` at least, as far as the next line lets it."""
    first = {line: s for line, _, s, _, _ in reversed(rows)}
    out = list(rows)
    for k, (line, w, s, e, o) in enumerate(rows):
        if k + 1 == len(rows) or rows[k + 1][0] != line:
            until = min(first[line] + LEAST_CUE, max(first.get(line + 1, float("inf")), e))
            out[k] = (line, w, s, max(e, round(until, 3)), o)
    return out


REPORT = "words int, alignable int, heard int, ignored int, exact int, near int, interpolated int, matched_fraction double, exact_fraction double, used_fraction double, mean_displacement double, longest_run int, markers int, grade string"
_CUE = "struct<start: double, end: double, text: string, words: array<struct<start: double, end: double, text: string>>>"


def align_pairs(pairs: DataFrame, keys: Sequence[str], text: str, cues: str, duration: str | None = None, timed: bool = False, **limits: int) -> DataFrame:
    """A report for each row of ``pairs`` (keys, text, cues: array of (start, end, text, words), duration of the audio).

    ``timed`` gives the words of the text with their times instead: (keys, line, place, word, start, end, origin). A null text is empty, a
    null array of cues holds none, a null or useless duration is unknown; a pair beyond the limits has the grade
    ``refused`` (and no words). Rows are aligned one by one, so any share of them may belong to one key.
    """
    keys = list(keys)
    kinds = dict(pairs.dtypes)
    names = [c.split()[0] for c in REPORT.split(", ")]
    long = F.col(duration).cast("double") if duration else F.lit(None).cast("double")
    rows = pairs.select(*keys, F.col(text).alias("__text"), F.col(cues).cast(f"array<{_CUE}>").alias("__cues"), F.when((long > 0) & (long < float("inf")), long).alias("__long"))

    def one(row: dict) -> list[dict]:
        own = {k: row[k] for k in keys}
        told = [(c["start"], c["end"], c["text"], [(w["start"], w["end"], w["text"]) for w in c["words"] or ()]) for c in row["__cues"] or () if c]
        try:
            words, figures = aligned((row["__text"] or "").splitlines(), heard_words(told), row["__long"], **limits)
        except TooLong:
            words, figures = [], {"grade": "refused"}
        if timed:
            return [own | {"line": w[0], "place": i, "word": w[1], "start": w[2], "end": w[3], "origin": w[4]} for i, w in enumerate(words)]
        return [own | dict.fromkeys(names) | figures]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in b.to_pylist() for r in one(row)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    tail = "line int, place int, word string, start double, end double, origin string" if timed else REPORT
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), tail])
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return rows.mapInArrow(run, ddl)
