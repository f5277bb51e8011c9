"""Languages of texts and of their lines, by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on clean sample texts. It
labels every byte position; the probabilities of the positions are pooled into those of a line, and
the lines of a record into its main language and its stretches of other languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.encoding import TRUE_WIDE, WRONG, likely_line
from measura.llm.runs import INTERJECTIONS
from measura.llm.unify import folded

#: units of each direction, sample rows read at most, passes over them, longest stretch of a sample line in one step of the fit
HIDDEN = 56
MAX_SAMPLES = 4000
EPOCHS = 100
STRETCH = 64
#: lines read side by side, and the positions that one pass over them holds unless a single line has more
BATCH, POSITIONS = 512, 400_000

# Codes and names of languages, and labels that name none.
THREE_LETTERS = {"eng": "en", "fra": "fr", "fre": "fr", "spa": "es", "deu": "de", "ger": "de", "ita": "it", "por": "pt", "rus": "ru", "pol": "pl", "nld": "nl", "dut": "nl", "swe": "sv", "jpn": "ja", "dan": "da", "nor": "no", "fin": "fi", "zho": "zh", "chi": "zh", "kor": "ko", "tur": "tr", "ukr": "uk", "ces": "cs", "cze": "cs", "ron": "ro", "rum": "ro", "hun": "hu", "ell": "el", "gre": "el", "ara": "ar", "heb": "he", "cat": "ca"}
NAMES = {"english": "en", "french": "fr", "spanish": "es", "german": "de", "italian": "it", "portuguese": "pt", "russian": "ru", "polish": "pl", "dutch": "nl", "swedish": "sv", "japanese": "ja", "français": "fr", "francais": "fr", "español": "es", "espanol": "es", "deutsch": "de", "italiano": "it", "português": "pt", "portugues": "pt", "русский": "ru", "polski": "pl", "nederlands": "nl", "svenska": "sv", "日本語": "ja"}
NO_LANGUAGE = frozenset("und mul zxx mis qaa xx xxx n/a na none null unknown auto ?? ? - other nn? unk".split())
#: words that no language owns: a line of nothing else doesn't count
VOCABLES = INTERJECTIONS | frozenset("do du di dam dum dom ba ban bap bop bom bam be bi bo sha shu sh ra ri ro ta ti tu tra tri tata ti lala nana dada doba u uo uh o e i lo li le ne no nah nanana lalala hm tk ts".split())
#: chains that undo the usual wrong decodings of a line before its language is read
_CHAINS = tuple((w, t) for t in TRUE_WIDE for w in WRONG)
_NARROW = (("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1250"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1251"))

_BRACKETED = re.compile(r"\[[^\]]*\]|\([^)]*\)|\*[^*]*\*")
_LETTERS, _DOUBLED, _BETWEEN = re.compile(r"[^\W\d_]+"), re.compile(r"(.)\1+"), re.compile(r"[^\w\s'’\-]+|[\d_]+")


def label_code(label: str | Column) -> Column:
    """Two-letter code that a label names, whatever its spelling, three-letter or regional form; null if it names none."""
    raw = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    base = F.regexp_extract(raw, r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    named = F.create_map(*[F.lit(x) for kv in (THREE_LETTERS | NAMES).items() for x in kv])
    code = F.coalesce(F.try_element_at(named, raw), F.try_element_at(named, base), F.when(F.length(base) == 2, base))
    return F.when(raw.isin(*NO_LANGUAGE) | base.isin(*NO_LANGUAGE) | (raw == ""), None).otherwise(code)


def line_text(line: str) -> str:
    """The words of a line in the form the network reads; empty if it holds no words of a language."""
    if not line.isascii():
        line = likely_line(line, _CHAINS, _NARROW)
    low = folded(_BRACKETED.sub(" ", line))
    if all(_DOUBLED.sub(r"\1", w) in VOCABLES for w in _LETTERS.findall(low)):
        return ""
    return " ".join(_BETWEEN.sub(" ", low).split())


def _tanh_gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """The network: for each of two directions a byte table (256 x 3H) and a recurrent matrix (H x 3H); one output layer for both."""

    def __init__(self, codes: Sequence[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.codes, self.hidden = list(codes), hidden
        h, k = hidden, len(self.codes)
        draw = lambda scale, *shape: rng.normal(0, 1 / np.sqrt(scale), shape).astype(np.float32)
        self.p = {"x": draw(h, 2, 256, 3 * h), "u": draw(h, 2, h, 3 * h), "o": draw(2 * h, 2 * h, k) * 0.5, "c": np.zeros(k, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """States (time, batch, 2H) over bytes ``x`` (time, batch), and what the way back needs; a masked step leaves the state alone.

        Both directions go step by step side by side, the second through the reversed bytes.
        """
        h, u = self.hidden, self.p["u"]
        steps, n = x.shape
        both, alive = np.stack([x, x[::-1]], 1), np.stack([mask, mask[::-1]], 1)[..., None]  # (time, way, batch)
        inputs = np.stack([self.p["x"][w][both[:, w]] for w in (0, 1)], 1)
        kind = self.p["u"].dtype
        before = np.zeros((steps + 1, 2, n, h), kind)
        zr, c = np.empty((steps, 2, n, 2 * h), kind), np.empty((steps, 2, n, h), kind)
        gates, inner = u[:, :, : 2 * h], u[:, :, 2 * h :]
        for t in range(steps):
            state = before[t]
            zr[t] = _tanh_gate(inputs[t, :, :, : 2 * h] + state @ gates)
            c[t] = np.tanh(inputs[t, :, :, 2 * h :] + (zr[t, :, :, h:] * state) @ inner)
            before[t + 1] = state + alive[t] * zr[t, :, :, :h] * (c[t] - state)
        return np.concatenate([before[1:, 0], before[:0:-1, 1]], axis=2), {"x": both, "alive": alive, "state": before[:-1], "zr": zr, "c": c}

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Language probabilities of every position (time, batch, language)."""
        logits = self._run(x, mask)[0] @ self.p["o"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=2, keepdims=True)

    def _gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rng: np.random.Generator, drop: float = 0.4) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time; ``y`` is the language of each part, or of each position (time, part)."""
        h, p = self.hidden, self.p
        y = np.broadcast_to(y, x.shape)[:, :, None]
        states, kept = self._run(x, mask)
        keep = (rng.random((1, x.shape[1], 2 * h)) >= drop).astype(np.float32) / np.float32(1 - drop)
        states = states * keep
        logits = states @ p["o"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        q = e / e.sum(axis=2, keepdims=True)
        n = mask.sum()
        loss = -float((np.log(np.take_along_axis(q, y, 2)[:, :, 0] + 1e-9) * mask).sum() / n)
        d = q - np.float32(0.1 / len(self.codes))  # smoothed labels: no position is sure
        np.put_along_axis(d, y, np.take_along_axis(d, y, 2) - np.float32(0.9), 2)
        d *= (mask / n)[:, :, None]
        g = {"o": states.reshape(-1, 2 * h).T @ d.reshape(-1, d.shape[2]), "c": d.sum((0, 1))}
        back = (d @ p["o"].T) * keep
        arriving = np.stack([back[:, :, :h], back[::-1, :, h:]], 1)
        state, alive, c = kept["state"], kept["alive"], kept["c"]
        z, r = kept["zr"][..., :h], kept["zr"][..., h:]
        by_z, by_c, by_r = alive * (c - state) * z * (1 - z), alive * z * (1 - c * c), state * r * (1 - r)
        stays = 1 - alive * z
        gates, inner = (np.ascontiguousarray(w.transpose(0, 2, 1)) for w in (p["u"][:, :, : 2 * h], p["u"][:, :, 2 * h :]))
        slope = np.empty((*c.shape[:3], 3 * h), c.dtype)
        carry = np.zeros_like(arriving[0])
        for t in range(len(x) - 1, -1, -1):
            dh = arriving[t] + carry
            dc = dh * by_c[t]
            drs = dc @ inner
            slope[t, :, :, :h] = dh * by_z[t]
            slope[t, :, :, h : 2 * h] = drs * by_r[t]
            slope[t, :, :, 2 * h :] = dc
            carry = dh * stays[t] + drs * r[t] + slope[t, :, :, : 2 * h] @ gates
        g["x"], g["u"] = np.zeros_like(p["x"]), np.empty_like(p["u"])
        for w in (0, 1):
            own, s, rs = slope[:, w].reshape(-1, 3 * h), state[:, w].reshape(-1, h), (r * state)[:, w].reshape(-1, h)
            g["u"][w, :, : 2 * h], g["u"][w, :, 2 * h :] = s.T @ own[:, : 2 * h], rs.T @ own[:, 2 * h :]
            read = kept["x"][:, w].reshape(-1)
            order = np.argsort(read, kind="stable")
            seen, first = np.unique(read[order], return_index=True)
            g["x"][w, seen] = np.add.reduceat(own[order], first, axis=0)
        return loss, g

    @classmethod
    def fit(cls, texts: Sequence[str], codes: Sequence[str], epochs: int = EPOCHS, seed: int = 11) -> BiGru:
        """Train on (text, code) samples.

        A step reads stretches, of a length drawn for the step, of their lines and sentences; to three of ten a
        stretch of another line is appended, so that the network learns where a language ends.
        """
        rng = np.random.default_rng(seed)
        known = sorted(set(codes))
        net = cls(known, seed=seed)
        place = {c: i for i, c in enumerate(known)}
        lines = [(line_text(s).encode(), place[c]) for t, c in zip(texts, codes, strict=True) for s in re.split(r"\n|(?<=[.!?])\s+", t)]
        lines = [(b, c) for b, c in lines if b]
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        step, total = 0, epochs * (len(lines) // 64 + 1)

        def stretch(i: int, longest: int) -> tuple[bytes, int]:
            b, c = lines[i]
            size = min(len(b), longest)
            at = int(rng.integers(0, len(b) - size + 1))
            return b[at : at + size], c

        for _ in range(epochs):
            order = rng.permutation(len(lines))
            batches = [order[i : i + 64] for i in range(0, len(order), 64)]
            for k in rng.permutation(len(batches)):
                some, longest = [], int(rng.integers(10, STRETCH + 1))
                for i in batches[k]:
                    some.append(stretch(i, longest))
                    if rng.random() < 0.3:
                        (a, c), (b, d) = some.pop(), stretch(int(rng.integers(len(lines))), longest)
                        keep = int(rng.integers(longest // 3, longest - longest // 3))
                        a, b = a[-keep:], b[: longest - keep]
                        some.append((a + b" " + b, [c] * len(a) + [d] * (len(b) + 1)))
                x, mask = _padded([b for b, _ in some])
                y = np.zeros(x.shape, np.int64)
                for i, (b, c) in enumerate(some):
                    y[: len(b), i] = c
                _, g = net._gradient(x, mask, y, rng)
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                rate = 0.006 * (1 - step / (total + 1)) * min(1.0, 1.0 / (norm + 1e-9))
                for name, v in g.items():
                    m, s = moment[name]
                    m *= 0.9
                    m += 0.1 * v
                    s *= 0.99
                    s += 0.01 * v * v
                    if name != "c":
                        net.p[name] *= np.float32(1 - 0.02 * rate)
                    net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return net

    def _way(self, way: int) -> tuple[np.ndarray, ...]:
        """Weights of one direction as the forward pass wants them: gates halved, as their sigmoid is taken by tanh."""
        h, x, u = self.hidden, self.p["x"][way].copy(), self.p["u"][way].copy()
        x[:, : 2 * h] *= 0.5
        u[:, : 2 * h] *= 0.5
        return x, np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :]), np.ascontiguousarray(self.p["o"][way * h : (way + 1) * h])

    def logits(self, parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(time, part, language) scores of every position, each part read whole in both directions, and the parts' sizes.

        ``parts`` are ordered by falling length, so those still running are always the first ones.
        """
        h, size = self.hidden, np.array([len(b) for b in parts])
        n, steps = len(parts), int(size.max(initial=0))
        running = np.searchsorted(-size, -np.arange(steps), side="left")
        x = np.zeros((steps, n), np.uint8)
        back = np.zeros((steps, n), np.uint8)
        for i, b in enumerate(parts):
            x[: len(b), i] = np.frombuffer(b, np.uint8)
            back[: len(b), i] = x[: len(b), i][::-1]
        out = np.zeros((steps, n, len(self.codes)), np.float32)
        flat, column = out.reshape(steps * n, -1), np.arange(n)
        for way, read in enumerate((x, back)):
            table, gates, inner, last = self._way(way)
            state = np.zeros((n, h), np.float32)
            for t, m in enumerate(running.tolist()):
                a, s = table[read[t, :m]], state[:m]
                zr = s @ gates
                zr += a[:, : 2 * h]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                c = (zr[:, h:] * s) @ inner
                c += a[:, 2 * h :]
                np.tanh(c, out=c)
                c -= s
                c *= zr[:, :h]
                s += c
                if way == 0:
                    np.add(s @ last, self.p["c"], out=out[t, :m])
                else:
                    flat[(size[:m] - 1 - t) * n + column[:m]] += s @ last
        return out, size

    def positions(self, texts: Sequence[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(places in ``texts``, logarithms of the probabilities (time, part, language), sizes) of batches of lines, long ones first."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            many = max(1, min(BATCH, POSITIONS // max(1, len(texts[order[at]]))))
            some = order[at : at + many]
            at += many
            logs, size = self.logits([texts[i] for i in some])
            for a in range(0, len(logs), 4096):  # in place, a stretch of time at once
                part = logs[a : a + 4096]
                part -= part.max(axis=2, keepdims=True)
                part -= np.log(np.exp(part).sum(axis=2, keepdims=True))
                np.maximum(part, np.float32(np.log(1e-6)), out=part)
            yield some, logs, size

    def lines(self, texts: Sequence[str]) -> np.ndarray:
        """Pooled probabilities (text, language): the mean over positions of log probabilities, as a distribution."""
        total = np.zeros((len(texts), len(self.codes)))
        size = np.ones(len(texts))
        for some, logs, length in self.positions([t.encode("utf-8", "replace") for t in texts]):
            logs *= (np.arange(len(logs))[:, None] < length)[:, :, None]
            total[some] = logs.sum(0, dtype=np.float64)
            size[some] = np.maximum(length, 1)
        # a position's evidence overlaps its neighbours'; about one in twelve is taken as independent
        pooled = total / size[:, None] * np.maximum(size / 12, 1)[:, None]
        pooled -= pooled.max(axis=1, keepdims=True)
        e = np.exp(pooled)
        return e / e.sum(axis=1, keepdims=True)


def _padded(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, parts))
    x, mask = np.zeros((longest, len(parts)), np.uint8), np.zeros((longest, len(parts)), np.float32)
    for i, b in enumerate(parts):
        x[: len(b), i] = np.frombuffer(b, np.uint8)
        mask[: len(b), i] = 1
    return x, mask


#: networks fitted in this process, by a hash of their samples
_FITTED: dict[int, BiGru] = {}


def trained(samples: DataFrame, code: str = "language_code", text: str = "text", most: int = MAX_SAMPLES) -> BiGru:
    """The network fitted to sample rows: at most ``most``, in a fixed order; rows without code or text are left out.

    A network fitted to the same rows before is used again.
    """
    rows = [tuple(r) for r in samples.where(F.col(code).isNotNull() & (F.trim(text) != "")).select(code, text).orderBy(F.xxhash64(code, text), code, text).limit(most).collect()]
    if len({r[0] for r in rows}) < 2:
        raise ValueError("samples of at least two languages are needed")
    mark = hash(tuple(rows))
    if mark not in _FITTED:
        _FITTED[mark] = BiGru.fit([r[1] for r in rows], [r[0] for r in rows])
    return _FITTED[mark]


#: logarithm of the odds that a change of language inside a line has to win
SWITCH = 6.0


def stretches(logs: np.ndarray, text: bytes) -> list[tuple[int, float, int]]:
    """(language, confidence, words) of each stretch of one language in a line, by its positions' log probabilities (position, language).

    The likeliest path of languages over the words of the line, where a change costs ``SWITCH``.
    """
    ends = [i for i, b in enumerate(text) if b == 32] + [len(text)]
    whole = np.vstack([np.zeros(logs.shape[1]), np.cumsum(logs, axis=0, dtype=np.float64)])
    words = np.diff(np.vstack([whole[[0]], whole[ends]]), axis=0) / 12  # as many positions as count for one
    best, came = words[0], []
    for w in words[1:]:
        top = int(best.argmax())
        jump = best[top] - SWITCH > best
        came.append(np.where(jump, top, np.arange(len(best))))
        best = np.where(jump, best[top] - SWITCH, best) + w
    path = [int(best.argmax())]
    for step in reversed(came):
        path.append(int(step[path[-1]]))
    path.reverse()
    out, at = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[at]:
            pooled = words[at:i].sum(0)
            out.append((path[at], float(1 / np.exp(pooled - pooled[path[at]]).sum()), i - at))
            at = i
    return out


_LABELLED = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("conf", T.DoubleType()), T.StructField("words", T.IntegerType())])


def line_languages(lines: DataFrame, net: BiGru, parts: bool = False) -> DataFrame:
    """(h1, h2, part, lang, conf, words) of each (h1, h2, line) with words of a language; other lines are left out.

    A line gives one row, its positions pooled, or with ``parts`` one for each stretch of one language in it.
    """
    sent = lines.sparkSession.sparkContext.broadcast((net.codes, net.hidden, net.p))  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, hidden, weights = sent.value
        model = BiGru.__new__(BiGru)
        model.codes, model.hidden, model.p = codes, hidden, weights
        for b in batches:
            h1, h2, texts = (c.to_pylist() for c in b.columns)
            forms = [line_text(t) for t in texts]
            at = [i for i, f in enumerate(forms) if f]
            if not at:
                continue
            if parts:
                raw, rows = [forms[i].encode("utf-8", "replace") for i in at], []
                for some, logs, size in model.positions(raw):
                    for k, i in enumerate(some):
                        rows += [(h1[at[i]], h2[at[i]], n, codes[lang], conf, words) for n, (lang, conf, words) in enumerate(stretches(logs[: size[k], k], raw[i]))]
            else:
                q = model.lines([forms[i] for i in at])
                rows = [(h1[i], h2[i], 0, codes[k], conf, forms[i].count(" ") + 1) for i, k, conf in zip(at, q.argmax(1).tolist(), q.max(1).tolist(), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_LABELLED.names)

    return lines.select("h1", "h2", "line").mapInArrow(run, _LABELLED)


def record_languages(items: DataFrame, net: BiGru, keys: Sequence[str], item: str, line: str, parts: bool = False) -> DataFrame:
    """(keys, item, part, lang, conf, words) of each line of each record: lines without words of a language are left out.

    ``items`` has one row for each line, told apart by the keys and ``item``; rows repeated under them with the
    same line count once, null lines and those without letters not at all. Each distinct line is read by the network once;
    what is joined back are hashes of 128 bits, so no text is shuffled twice. ``parts`` as in ``line_languages``.
    """
    keys = list(keys)
    rows = items.where(F.col(line).rlike(r"\p{L}")).select(*keys, item, F.col(line).alias("line"))
    hashed = rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})
    distinct = hashed.select("h1", "h2", "line").distinct()
    once = hashed.select(*keys, item, "h1", "h2").distinct()
    return once.join(line_languages(distinct, net, parts), ["h1", "h2"]).drop("h1", "h2")
