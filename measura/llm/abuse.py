"""Scores for abusive, hateful, threatening or sexually explicit content.

A logistic model over the sentences of a document, fitted by multiple-instance learning to
verdicts on documents: a flagged document holds at least one abusive sentence, an unflagged one
none. To keep neutral mentions of groups from counting as abuse, the fit is regularised by
counterfactuals: identity terms in labelled sentences are swapped for other identity terms and a
change of the score is penalised. The score of a document is that of its worst sentence.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.unify import folded

#: labelled documents that the model is fitted on at most (half of each verdict where there are enough)
MAX_LABELLED = 6000
#: sentences from which on those of a document share its weight in the fit
FULL_SENTENCES = 60
BITS = 18
#: weight of the counterfactual penalty
SWAP_PENALTY = 0.3

#: verdicts of either kind that a language needs before its flagged documents are learned from; below, the model abstains in it
LEAST_FLAGGED, LEAST_UNFLAGGED = 5, 20

# Words that name groups of people, by language and number; those of one line swap for each other.
IDENTITY_TERMS = {
    "en": "women men immigrants foreigners refugees muslims jews christians gays lesbians girls boys americans mexicans blacks whites asians catholics atheists migrants",
    "en, one": "woman man immigrant foreigner refugee muslim jew christian lesbian girl boy american mexican catholic atheist migrant",
    "es": "mujeres hombres inmigrantes extranjeros refugiados musulmanes judíos cristianos gays lesbianas gitanos",
    "es, one": "mujer hombre inmigrante extranjero refugiado musulmán judío cristiano lesbiana gitano",
    "de": "frauen männer einwanderer ausländer flüchtlinge muslime juden christen schwule lesben türken",
    "de, one": "frau mann einwanderer ausländer flüchtling muslim jude christ lesbe türke",
    "fr": "femmes hommes immigrés étrangers réfugiés musulmans juifs chrétiens gays lesbiennes",
    "fr, one": "femme homme immigré étranger réfugié musulman juif chrétien lesbienne",
    "it": "donne uomini immigrati stranieri rifugiati musulmani ebrei cristiani gay lesbiche zingari",
    "pt": "mulheres homens imigrantes estrangeiros refugiados muçulmanos judeus cristãos gays lésbicas",
    "nl": "vrouwen mannen immigranten buitenlanders vluchtelingen moslims joden christenen homo's lesbiennes",
    "sv": "kvinnor män invandrare utlänningar flyktingar muslimer judar kristna bögar lesbiska",
    "pl": "kobiety mężczyźni imigranci obcokrajowcy uchodźcy muzułmanie żydzi chrześcijanie geje lesbijki",
    "ru": "женщины мужчины мигранты иностранцы беженцы мусульмане евреи христиане геи лесбиянки",
    "ru, of": "женщин мужчин мигрантов иностранцев беженцев мусульман евреев христиан геев лесбиянок",
    "ja": "女性 男性 移民 外国人 難民 老人 若者 韓国人 中国人 同性愛者",
}
SECOND_PERSON = frozenset("you your yours u ur yourself tu te ti tus tuyo usted vos vosotros du dich dir dein deine deinen euch ihr toi ton ta tes vous votre tuo tua tuoi tue voi vocês você seu sua teu tua jij je jou jouw u dig din ditt dina ty ciebie cię ci twój twoja wy ты тебя тебе твой твоя твою вы вас вам お前 おまえ あなた てめえ 君 きみ".split())
FIRST_PERSON = frozenset("i my me myself mine yo mi mis me ich mich mir mein meine je moi mon ma mes io mio mia eu meu minha ik mij mijn jag mig min mitt ja mnie mój moja я меня мне мой моя 俺 私 僕 おれ".split())

_LEET = str.maketrans("@$013457!€", "asoieastie")
_TOKEN = re.compile(r"[^\W_](?:[\w@$!*€'’]*[\w@$*€])?[*]*|[@$][\w@$!*€]*\w")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
_DOUBLED = re.compile(r"(.)\1+")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])[\"”»)]*\s+|\s*[\r\n]+\s*")
_PREFIX = re.compile(r"^(?:\[[\d:.]+\]\s*|[\w.\-]{2,20}:\s+|\d{4}-\d\d-\d\d\s+|[\-*•>]\s+)+")
_DENSE = re.compile("[぀-ヿ一-鿿]")


def sentences(text: str) -> list[str]:
    """The sentences and lines of a text, without speaker names, dates and time stamps in front."""
    return [s for s in (_PREFIX.sub("", x.strip()) for x in _SENTENCE.split(text)) if s]


@lru_cache(200_000)
def _word(w: str) -> tuple[str, ...]:
    if not w.isalpha():
        if "*" in w:
            return (f"{w[0]}*{w[-1] if w[-1] != '*' else ''}{len(w)}",)
        if w.isdigit():
            return ("0",)
        w = w.translate(_LEET)
    w = _DOUBLED.sub(r"\1", w.strip("'’"))
    if _DENSE.search(w):
        return tuple(w[i : i + 2] for i in range(max(1, len(w) - 1)))
    return (w,) if w else ()


def words(sentence: str) -> list[str]:
    """Lower-case words with disguises undone: look-alike and drawn-out letters, digits and signs for letters, spaced-out words."""
    text = folded(sentence)
    found = _TOKEN.findall(text)
    if sum(len(w) == 1 for w in found) > 3:
        found = _TOKEN.findall(_SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text))
    return [x for w in found for x in _word(w)]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


@lru_cache(100_000)
def _word_slots(word: str) -> tuple[int, ...]:
    out = [_slot("w:" + word)]
    if len(word) >= 4 and "*" not in word:
        padded = f"<{word}>"
        out += [_slot("c:" + padded[i : i + 4]) for i in range(len(padded) - 3)]
    elif "*" in word:
        out += [_slot("masked"), _slot("m:" + word[:1] + word[-2:])]
    return tuple(out)


def _who(tokens: Sequence[str]) -> str:
    """Whether a sentence speaks to someone (2), else of the speaker (1), else of others (0)."""
    return "2" if any(t in SECOND_PERSON for t in tokens) else "1" if any(t in FIRST_PERSON for t in tokens) else "0"


@lru_cache(400_000)
def _pair_slot(kind: str, one: str, two: str) -> int:
    return _slot(f"{kind}{one} {two}")


def slots(tokens: Sequence[str]) -> np.ndarray:
    """The hashed features of a sentence: words, their letters, neighbours, and who is spoken to or of."""
    out: list[int] = []
    who, before = _who(tokens), "<s>"
    for t in tokens:
        out.extend(_word_slots(t))
        out.append(_pair_slot("b:", before, t))
        out.append(_pair_slot("p:", who, t))
        before = t
    out.append(_pair_slot("b:", before, "</s>"))
    return np.array(out, np.int32)


class _Rows:
    """Sparse binary rows."""

    def __init__(self, rows: list[np.ndarray]):
        sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.edge = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.scale = 1 / np.sqrt(np.maximum(sizes, 1))
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], self.n) * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, (g * self.scale)[self.owner], 1 << BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _term_index(terms: dict[str, str]) -> tuple[dict[tuple[str, ...], str], dict[str, list[tuple[str, ...]]]]:
    """The terms as the words they are read as: the line of each, and the terms of each line."""
    lines = {name: [tuple(words(t)) for t in told.split()] for name, told in terms.items()}
    return {t: name for name, own in reversed(lines.items()) for t in own}, lines


_LINE_OF, _TERMS = _term_index(IDENTITY_TERMS)
_LONGEST = max(map(len, _LINE_OF))


def _mentions(tokens: Sequence[str]) -> list[tuple[int, int, str]]:
    """(from, to, line) of the identity terms among ``tokens``, the longest at each place."""
    out, i = [], 0
    while i < len(tokens):
        n = next((n for n in range(min(_LONGEST, len(tokens) - i), 0, -1) if tuple(tokens[i : i + n]) in _LINE_OF), 0)
        if n:
            out.append((i, i + n, _LINE_OF[tuple(tokens[i : i + n])]))
        i += n or 1
    return out


def _swaps(tokens: Sequence[str], rng: np.random.Generator) -> list[list[str]]:
    """The sentence with its identity terms swapped for others, twice; none without such a term."""
    where = _mentions(tokens)
    out = []
    for _ in range(2 if where else 0):
        other, at = [], 0
        for a, b, line in where:
            own = _TERMS[line]
            other += [*tokens[at:a], *own[int(rng.integers(len(own)))]]
            at = b
        out.append([*other, *tokens[at:]])
    return out


def _cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the thresholds whose F1 on the labelled documents is within a hundredth of the best."""
    grid = np.arange(0.3, 0.95, 0.02)
    f1 = []
    for t in grid:
        hit = (scores >= t) & (labels == 1)
        f1.append(2 * hit.sum() / max(1, (scores >= t).sum() + (labels == 1).sum()))
    good = grid[np.array(f1) >= max(f1) - 0.01]
    return float((good[0] + good[-1]) / 2)


class AbuseModel:
    """Weights of the sentence model and the threshold on the score of a document."""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float):
        self.weights, self.bias, self.threshold = weights, bias, threshold

    @classmethod
    def fit(cls, texts: Sequence[str], labels: Sequence[int], groups: Sequence[str | None] | None = None, rounds: int = 6, steps: int = 40, l2: float = 1e-4, seed: int = 7, swap_penalty: float = SWAP_PENALTY) -> AbuseModel:
        """The model of ``texts`` with verdicts ``labels`` (1 flagged, 0 not).

        ``groups`` names the language of each text. A few flagged texts of a language can't tell abuse from the language itself, so those
        of no known language, or one with fewer than ``LEAST_FLAGGED`` flagged or ``LEAST_UNFLAGGED`` other texts, are left out.
        """
        if groups is not None:
            told = Counter(zip(groups, labels, strict=True))
            kept = [i for i, (g, v) in enumerate(zip(groups, labels, strict=True)) if v != 1 or g and told[g, 1] >= LEAST_FLAGGED and told[g, 0] >= LEAST_UNFLAGGED]
            texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
        rng = np.random.default_rng(seed)
        index: dict[tuple[str, ...], int] = {}
        owner: list[int] = []
        which: list[int] = []
        for d, t in enumerate(texts):
            for s in dict.fromkeys(sentences(t)):
                if w := tuple(words(s)):
                    owner.append(d)
                    which.append(index.setdefault(w, len(index)))
        y, own, at = np.asarray(labels, float), np.asarray(owner, np.int64), np.asarray(which, np.int64)
        model = cls(np.zeros(1 << BITS), -2.0, 0.5)
        if not len(own) or not 0 < y.sum() < len(y):
            return model
        tokens = list(index)  # each distinct sentence once
        every = [slots(t) for t in tokens]
        rows = _Rows(every)
        label = y[own]
        part = np.minimum(1.0, FULL_SENTENCES / np.maximum(np.bincount(own, minlength=len(y)), 1))[own]  # a long document has no more say than one of that many sentences
        clean = np.bincount(at, label == 0, len(tokens))  # documents without a flag that hold the sentence
        share_flagged, share_all = np.bincount(at, part * label, len(tokens)), np.bincount(at, part, len(tokens))
        hits = np.bincount(rows.at, share_flagged[rows.owner], 1 << BITS)
        total = np.bincount(rows.at, share_all[rows.owner], 1 << BITS)
        prior = np.average(label, weights=part)
        odds = np.log((hits + prior) / (total - hits + 1 - prior)) - np.log(prior / (1 - prior))
        score = rows.dot(odds)  # first guess: words that stand mostly in flagged documents
        # boilerplate of documents flagged by mistake holds no feature that flagged documents own
        share = (hits + 2 * prior) / (total + 2)
        telling = np.maximum.reduceat(share[rows.at], rows.edge) >= max(0.5, 1.4 * prior)
        w, b = np.zeros(1 << BITS), -1.0
        m, v, t = np.zeros(1 << BITS), np.zeros(1 << BITS), 0
        for r in range(rounds):
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, own, score[at])
            # a verdict may be wrong: a guilty sentence must score above what documents without a flag reach
            unflagged = best[np.isfinite(best) & (y == 0)]
            floor = np.quantile(unflagged, 0.97 if r < 2 else 0.98) if len(unflagged) else 0.0
            floor = floor if r < 2 else max(floor, 0.0)
            in_flagged = (label == 1) & telling[at] & (score[at] > floor) & ((score[at] >= best[own] - 1e-9) | (score[at] > 0 if r else False))
            guilty = np.zeros(len(tokens))
            np.add.at(guilty, at[in_flagged], 1.0)
            guilty[clean >= np.maximum(guilty, 1)] = 0.0  # the sentence itself stands in as many unflagged documents
            mass = np.where(guilty > 0, np.bincount(at[in_flagged], part[in_flagged], len(tokens)), 0.0)
            # sentences of unflagged documents: the ones that look worst, and some of the rest
            order = np.lexsort((-score[at], own))
            place = np.arange(len(order)) - np.r_[0, np.flatnonzero(np.diff(own[order])) + 1][np.cumsum(np.r_[0, np.diff(own[order]) != 0])]
            hard = np.zeros(len(tokens), bool)
            hard[at[order[(place < 3) & (label[order] == 0)]]] = True
            hard |= (clean > 0) & (score > min(floor, 0.0) - 1.0)
            use = np.flatnonzero((guilty > 0) | hard | ((clean > 0) & (rng.random(len(tokens)) < 0.1)))
            sub = _Rows([every[i] for i in use])
            pairs = [(k, s) for k, i in enumerate(use) for s in _swaps(list(tokens[i]), rng)]
            swapped, source = _Rows([slots(s) for _, s in pairs]), np.array([k for k, _ in pairs], np.int64)
            pos, neg = mass[use], np.minimum(clean[use], 10.0)
            pos = pos * (neg.sum() / max(1.0, pos.sum()) * 0.3)
            whole = (pos + neg).sum()
            for _ in range(steps):
                t += 1
                p = _sigmoid(sub.dot(w) + b)
                g = (p * (pos + neg) - pos) / whole
                grad = sub.back(g) + l2 * w
                if len(source):
                    drift = (sub.dot(w)[source] - swapped.dot(w)) * swap_penalty / len(source)
                    grad += sub.back(np.bincount(source, drift, sub.n)) - swapped.back(drift)
                m = 0.9 * m + 0.1 * grad
                v = 0.99 * v + 0.01 * grad * grad
                w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (np.abs(grad) > 1e-12)
                b -= 0.5 * g.sum()
            score = rows.dot(w) + b
        model.weights, model.bias = w, float(b)
        best = np.full(len(y), -30.0)
        np.maximum.at(best, own, score[at])
        model.threshold = _cut(_sigmoid(best), y)
        return model

    def scorer(self):
        """A function from a text to the score of its worst sentence; words, neighbours and sentences met before are remembered."""
        weights, bias, most = self.weights, self.bias, 100_000
        of_word: dict[str, tuple[float, int]] = {}
        of_pair: dict[tuple[str, str], float] = {}
        of_who: dict[tuple[str, str], float] = {}
        known: dict[str, float] = {}

        def margin(sentence: str) -> float:
            tokens = words(sentence)
            if not tokens:
                return -30.0
            who, before, total, n = _who(tokens), "<s>", 0.0, 1
            for t in tokens:
                if (x := of_word.get(t)) is None:
                    at = _word_slots(t)
                    x = of_word[t] = (float(sum(weights[i] for i in at)), len(at) + 2)
                if (y := of_pair.get((before, t))) is None:
                    y = of_pair[before, t] = float(weights[_slot(f"b:{before} {t}")])
                if (z := of_who.get((who, t))) is None:
                    z = of_who[who, t] = float(weights[_slot(f"p:{who} {t}")])
                total += x[0] + y + z
                n += x[1]
                before = t
            total += float(weights[_slot(f"b:{before} </s>")])
            if len(of_pair) > 4 * most:
                of_pair.clear(), of_word.clear(), of_who.clear()
            return total / n**0.5 + bias

        def score(text: str | None) -> float:
            if not text:
                return 0.0
            worst = -30.0
            for s in sentences(text):
                x = known.get(s)
                if x is None:
                    x = margin(s)
                    if len(s) < 300:
                        if len(known) >= most:
                            known.clear()
                        known[s] = x
                if x > worst:
                    worst = x
            return float(1 / (1 + np.exp(-worst))) if worst > -30 else 0.0

        return score


@F.arrow_udf(T.StringType())
def _distinct_sentences(texts: pa.Array) -> pa.Array:
    """Each text with its sentences on lines of their own, once each; what stands in front of them is left for ``sentences``."""
    return pa.array(["\n".join(dict.fromkeys(filter(None, map(str.strip, _SENTENCE.split(t))))) for t in texts.to_pylist()], pa.string())


def labelled(documents: DataFrame, verdicts: DataFrame, key: str = "doc_id", text: str = "text", verdict: str = "verdict", group: str | None = None, most: int = MAX_LABELLED) -> list[tuple[str, int, str | None]]:
    """(distinct sentences, verdict, group) of at most ``most`` documents whose verdicts agree, in a fixed order of hashes; undecided ones are left out.

    The verdicts are chosen first, so the documents meet at most ``most`` keys, which are broadcast. Whole texts are
    split on the executors; the driver gets each sentence of a document once. Documents without text give none.
    """
    said = verdicts.where(F.col(verdict).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(verdict).alias("__low"), F.max(verdict).alias("__said")).where("__low = __said")
    parts = [said.where(F.col("__said") == v).orderBy(F.xxhash64(key), key).limit(most // 2).select(key, "__said") for v in (0, 1)]
    named = F.col(group).cast("string") if group else F.lit(None).cast("string")
    docs = documents.select(key, F.col(text).alias("__text"), named.alias("__group")).where("__text <> ''")
    rows = docs.join(F.broadcast(parts[0].unionByName(parts[1])), key).select(F.xxhash64(key).alias("__h"), key, _distinct_sentences("__text").alias("__text"), "__said", "__group").collect()
    return [(r["__text"], int(r["__said"]), r["__group"]) for r in sorted(rows, key=lambda r: (r["__said"], r["__h"], r[key]))]


def abuse_scores(documents: DataFrame, model: AbuseModel, text: str | Column = "text") -> Column:
    """DOUBLE score of each text by ``model`` (0 for null, empty and wordless texts): whole texts, one narrow pass."""
    sent = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 2 ** BITS numbers

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        key = sent.id if hasattr(sent, "id") else id(sent)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = AbuseModel(*sent.value, 0.5).scorer()
        one = _SCORERS[key]
        return pa.array([one(t) for t in texts.to_pylist()], pa.float64())

    return score.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


_SCORERS: dict = {}
