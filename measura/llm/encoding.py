"""Repair of text that was decoded with the wrong character encoding.

Lines (titles, names, lyric lines) are compared on what a wrong decoding leaves alone: the text
stripped of non-ASCII characters. Garbled lines meet their clean near-twins there, the gaps
between the ASCII characters are aligned, and each aligned pair votes for the transformations
(wrong codec, true codec) that turn the one into the other. The transformations with enough votes
are then applied to all other lines. Scripts that leave no ASCII behind find their twins by
decoding: a candidate counts if the decoded line is itself a more common line of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from encodings.aliases import aliases
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.unify import CYRILLIC_AS_LATIN, GREEK_AS_LATIN
from measura.session import cut

#: Codecs that texts are usually read with wrongly, and codecs they were written in; they are tried before all others.
WRONG = ("cp1252", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "cp1250", "cp852")
TRUE_WIDE = ("utf-8", "cp932", "euc_jp")
TRUE_NARROW = ("cp1251", "koi8_r", "cp1252", "mac_roman", "cp866", "cp850", "cp1250", "cp437")
CHAINS = tuple((w, t) for w in WRONG for t in (*TRUE_WIDE, *TRUE_NARROW) if w != t)

#: letters that look like Latin ones, small Greek letters of a shape of their own left out
POSING = frozenset(CYRILLIC_AS_LATIN) | frozenset(c for c in GREEK_AS_LATIN if c.isupper() or c in "ονρ")
#: share of the lines with characters beyond ASCII that must vote for a transformation before it is applied, at least one line
MIN_SHARE = 3e-5
#: ASCII letters a stripped text needs to identify a twin
MIN_ASCII = 8


def _byte_of(codec: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    if codec == "cp1252":  # and ISO 8859-1, whose upper controls cp1252 leaves free
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def _bytes_of(codec: str) -> dict[str, int]:
    return _byte_of(codec)


@lru_cache(1)
def other_chains() -> tuple[tuple[str, str], ...]:
    """Every pair of single-byte codecs that Python knows (and UTF-8 read by one) beside ``CHAINS``."""

    def single(codec: str) -> bool:
        try:
            return bytes(range(0x20, 0x7F)).decode(codec) == "".join(map(chr, range(0x20, 0x7F))) and len(bytes(range(0x80, 0x100)).decode(codec, "replace")) == 0x80
        except (LookupError, UnicodeError):
            return False

    narrow = sorted(c for c in set(aliases.values()) if c not in ("ascii", "mbcs", "oem") and single(c))
    met = set(CHAINS)
    return tuple((w, t) for w in narrow for t in ("utf-8", *narrow) if w != t and (w, t) not in met)


def undo(text: str, wrong: str, true: str) -> str | None:
    """``text`` read again: back to bytes by ``wrong``, decoded by ``true``; None if that fails."""
    table, raw = _bytes_of(wrong), bytearray()
    for c in text:
        if c < "\x80":
            raw.append(ord(c))
        elif c in table:
            raw.append(table[c])
        else:
            return None
    try:
        out = raw.decode(true)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


_ODD_KIND = {"Cc", "Co", "Cn", "So", "Sm", "Sc", "Sk", "No"}
#: blocks that restored text may hold: letters of the scripts read here, punctuation and symbols
_PLAUSIBLE = ((0x20, 0x7E), (0xA0, 0x24F), (0x2BB, 0x2BD), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x21FF), (0x2600, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF))
_LOSS = re.compile("�|(?<=[A-Za-z])\\?+(?=[A-Za-z])")


@lru_cache(100_000)
def _category(c: str) -> str:
    return unicodedata.category(c)


@lru_cache(100_000)
def _script(c: str) -> str:
    name = unicodedata.name(c, "?").split(" ", 1)[0]
    return "JAPANESE" if name in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC", "HALFWIDTH", "FULLWIDTH") else name


def oddness(text: str) -> int:
    """How much of ``text`` looks unlike words: symbols and controls beside letters, scripts mixed inside a word, capitals after small letters."""
    score, last, last_script = 0, " ", ""
    for at, c in enumerate(text):
        if c.isalpha():
            if c > "\x7f" or last > "\x7f":
                script = _script(c)
                if last.isalpha():
                    score += (script != (last_script or _script(last))) + (c.isupper() and last.islower())
                last_script = script
            else:
                last_script = ""
        elif c > "\x7f" and (c == "�" or _category(c) in ("Cc", "Co", "Cn")):
            score += 2
        elif c > "\x7f" and _category(c) in _ODD_KIND and (last.isalpha() or text[at + 1 : at + 2].isalpha()) or c in "¿¡§¶†‡•…‰„‚‹›«»" and last.isalpha() and text[at + 1 : at + 2].isalpha():
            score += 1
        last = c
    return score


def _plausible(text: str) -> bool:
    return all(any(a <= ord(c) <= b for a, b in _PLAUSIBLE) for c in text if c not in "\t\r\n")


def _skeleton(text: str) -> str:
    return "".join(c for c in text.lower() if c < "\x80" and c != "?")


def _gaps(text: str) -> list[str]:
    """The stretches between neighbouring ASCII characters (question marks count as gaps)."""
    return re.split(r"[\x00-\x3e\x40-\x7f]", text)


_WORD = re.compile(r"[^\s\x00-\x26\x28-\x2c./:-@\[-`{-~“”]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_BESIDE = re.compile(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]")


def _wide(text: str, chains: Sequence[tuple[str, str]]) -> str | None:
    """``text`` with its runs of non-ASCII characters, or all of it, read again as multi-byte text; None if nothing changes."""
    for wrong, true in chains:
        if true == "utf-8":
            def fix(m: re.Match, wrong: str = wrong) -> str:
                out = undo(m[0], wrong, "utf-8")
                if out is not None and all(_script(c) == "CYRILLIC" for c in m[0]) and any(_script(c) == "JAPANESE" for c in out):
                    return m[0]  # a Russian word of three letters may happen to be the bytes of one sign
                return out if out is not None and (_plausible(out) or undo(out, "cp1252", "utf-8")) else m[0]

            out = _RUN.sub(fix, text)
            if out != text and len(out) < len(text):
                return out
        elif true == "euc_jp" and "\x8f" in text:  # the sign that a letter of three bytes follows: Latin, Greek or Cyrillic ones with marks
            out = _RUN.sub(lambda m, wrong=wrong: m[0] if (new := undo(m[0], wrong, "euc_jp")) is None or not _plausible(new) else new, text)
            if len(out) < len(text):
                return out
        elif true in ("cp932", "euc_jp") and len(text) > 1 and oddness(text):
            out = undo(text, wrong, true)
            if out is not None and len(out) < len(text):
                new = [c for c in out if c > "\x7f"]
                if len(new) > 1 and all(_script(c) == "JAPANESE" and not 0xFF61 <= ord(c) <= 0xFF9F or c in "、。・ー〜「」々" for c in new) and not _BESIDE.search(out):
                    return out
    return None


@lru_cache(50_000)
def _poses(word: str) -> bool:
    """Whether a word mixes scripts only by letters that pose as its own: that isn't a wrong decoding."""
    foreign = [c for c in word if c > "\x7f" and _script(c) in ("CYRILLIC", "GREEK")]
    return 0 < len(foreign) < sum(map(str.isalpha, word)) and all(c in POSING for c in foreign)


@lru_cache(50_000)
def _word_readings(word: str, chains: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """(reading, chain) of an odd or long word by each single-byte chain that makes a word of it."""
    if len(word) <= 3 and not oddness(word) or _poses(word):
        return ()
    out = []
    for wrong, true in chains:
        fixed = undo(word, wrong, true)
        if fixed is not None and all(c.isalpha() or c in "'’-" for c in fixed.strip("“”") if c > "\x7f") and oddness(fixed) == 0 and _plausible(fixed):
            out.append((fixed, f"{wrong}>{true}"))
    return tuple(out)


def restore_line(text: str, chains: Sequence[tuple[str, str]]) -> tuple[str, bool, list[tuple[str, str, str]]]:
    """(text so far, changed, [(word, reading, chain)]): multi-byte repairs are sure, single-byte readings of odd words need a known word."""
    out, changed = text, False
    while (better := _wide(out, chains)) is not None:  # text may have been garbled more than once; each reading is shorter
        out, changed = better, True
    if out.isascii():
        return out, changed, []
    narrow = tuple((w, t) for w, t in chains if t not in TRUE_WIDE)
    return out, changed, [(word, *r) for word in dict.fromkeys(_WORD.findall(out)) if not word.isascii() for r in _word_readings(word, narrow)]


def likely_line(text: str, wide: Sequence[tuple[str, str]], narrow: Sequence[tuple[str, str]]) -> str:
    """``text`` as it most likely should read, judged by the line alone: for uses that can do without the corpus."""

    def strange(t: str) -> int:
        letters = sum(map(str.isalpha, t))
        return oddness(t) + 3 * (letters > 3 and sum("\xbf" < c < "\u0180" for c in t) * 2 > letters)

    if not strange(text):
        return text
    out = restore_line(text, wide)[0]
    best = (strange(out), out)
    for wrong, true in narrow if best[0] else ():
        read = _WORD.sub(lambda m, wrong=wrong, true=true: m[0] if m[0].isascii() else undo(m[0], wrong, true) or m[0], out)
        if read != out and _plausible(read):
            best = min(best, (strange(read), read), key=lambda x: x[0])
    return best[1]


_PAIRS = T.StructType([T.StructField("skeleton", T.StringType()), T.StructField("odd", T.IntegerType()), T.StructField("other", T.IntegerType())])


@F.arrow_udf(_PAIRS)  # its result is kept, so it runs once
def _stripped(lines: pa.Array) -> pa.Array:
    texts = lines.to_pylist()
    skeletons = [_skeleton(t) for t in texts]
    long_enough = [s if sum(c.isalpha() for c in s) >= MIN_ASCII else None for s in skeletons]
    return pa.StructArray.from_arrays(
        [pa.array(long_enough, pa.string()), pa.array([oddness(t) + (t.count("?") if _LOSS.search(t) else 0) for t in texts], pa.int32()), pa.array([sum(c > "\x7f" for c in t) for t in texts], pa.int32())],
        names=["skeleton", "odd", "other"],
    )


@lru_cache(50_000)
def _explained(garbled: str, clean: str, usual: bool) -> frozenset[str]:
    """The chains, of the usual ones or of all others that Python knows, that turn one gap into the other."""
    return frozenset(f"{w}>{t}" for w, t in (CHAINS if usual else other_chains()) if (once := undo(garbled, w, t)) is not None and once.lower() == clean.lower())


def _voted(garbled: str, clean: str) -> frozenset[str]:
    """The chains that explain all gaps of a garbled line by its twin; where none does, those that explain one."""
    gaps = [(g, c) for g, c in zip(_gaps(garbled), _gaps(clean), strict=False) if g and c and g.lower() != c.lower() and "�" not in g and "?" not in g]
    if not gaps:
        return frozenset()
    for usual in (True, False):
        told = [_explained(g, c, usual) for g, c in gaps]
        if whole := frozenset.intersection(*told):
            return whole
    return frozenset.union(*(_explained(g, c, True) for g, c in gaps))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of (garbled line, clean twin) pairs for the transformations that explain them."""
    for b in batches:
        votes = Counter(" ".join(sorted(v)) for g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (v := _voted(g, c)))
        if votes:
            yield pa.RecordBatch.from_arrays([pa.array(list(votes)), pa.array(list(votes.values()), pa.int64())], names=["chain", "votes"])


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All readings of lines whose script leaves no ASCII to strip to."""
    for b in batches:
        out = []
        for line, n, odd in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for wrong, true in CHAINS:
                fixed = undo(line, wrong, true)
                if fixed is not None and len(fixed) <= len(line):
                    out.append((f"{wrong}>{true}", fixed, n, odd))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], names=["chain", "line", "n", "odd"])


def learn(lines: DataFrame, min_share: float = MIN_SHARE) -> list[tuple[str, str]]:
    """The transformations found in ``lines`` (line, n: distinct lines and how often each stands).

    The votes a transformation needs grow with the lines that may be garbled (``min_share`` of them), so chance
    agreements stay out of large corpora and single garbled lines count in small ones. What reaches the driver is a count for each set of codec pairs that agree on a twin, never a
    line. A cover is chosen greedily, so of codecs that read alike only the best supported stays.
    """
    marked = lines.where(F.col("line").rlike(r"[^\x00-\x7F]|\?")).withColumn("s", _stripped("line")).select("line", "n", "s.*").persist(StorageLevel.DISK_ONLY)
    best = marked.where("skeleton IS NOT NULL").groupBy("skeleton").agg(F.min_by("line", F.struct("odd", "other", -F.col("n"), "line")).alias("clean"), F.min("odd").alias("least"), F.count("*").alias("variants")).where("variants > 1")
    twins = marked.where("odd > 0").join(best.where("least = 0").select("skeleton", "clean"), "skeleton").where("line <> clean").select("line", "clean")
    votes = twins.mapInArrow(_align, "chain string, votes long")
    bare = marked.where("skeleton IS NULL AND other >= 4").select("line", "n", "odd")
    read = bare.mapInArrow(_readings, "chain string, line string, n long, odd int")
    common = marked.select("line", F.col("n").alias("m"), F.col("odd").alias("odd_there"))
    met = read.join(common, "line").where("odd_there < odd OR (odd_there = odd AND m > n)").groupBy("chain").agg(F.count("*").alias("votes"))
    counted = Counter({frozenset(r["chain"].split()): r["votes"] for r in votes.unionByName(met).groupBy("chain").agg(F.sum("votes").alias("votes")).collect()})
    needed = max(1.0, min_share * marked.count())
    marked.unpersist()
    single: Counter[str] = Counter()
    for together, v in counted.items():
        for c in together:
            single[c] += v
    kept: list[tuple[str, str]] = []
    while True:  # the chain that explains most of what no chosen one explains
        open_: Counter[str] = Counter()
        for together, v in counted.items():
            for c in together:
                open_[c] += v
        best_chain = min(open_, key=lambda c: (-open_[c], -single[c], c), default=None)
        if best_chain is None or open_[best_chain] < needed:
            return kept
        wrong, true = best_chain.split(">")
        kept.append((wrong, true))
        counted = Counter({t: v for t, v in counted.items() if best_chain not in t})


_OUT = T.StructType([T.StructField("now", T.StringType()), T.StructField("changed", T.BooleanType()), T.StructField("lost", T.BooleanType()), T.StructField("readings", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("fixed", T.StringType()), T.StructField("chain", T.StringType()), T.StructField("odd", T.BooleanType())])))])
_TOKENS = r"[^\p{L}\p{M}\p{N}'’-]+"


def _plain_word(column: str) -> Column:
    return F.regexp_replace(F.lower(column), "[“”]", "")


def repair_lines(lines: DataFrame, chains: Sequence[tuple[str, str]]) -> DataFrame:
    """(line, restored, is_restored) of each garbled line of ``lines`` (line, n).

    A line is garbled if a learned multi-byte reading fits it, if a single-byte reading turns one
    of its words into a more common word of the corpus, or if it holds replacement characters
    (or question marks inside words). Lost characters come back from the clean twin: the only line,
    or word, of the corpus that agrees on everything else; ``is_restored`` says whether all came back.
    """
    chains = list(chains)
    kind = pa.list_(pa.struct([("word", pa.string()), ("fixed", pa.string()), ("chain", pa.string()), ("odd", pa.bool_())]))

    @F.arrow_udf(_OUT)
    def apply(texts: pa.Array) -> pa.Array:
        now, changed, lost, readings = [], [], [], []
        for t in texts.to_pylist():
            out, did, words = restore_line(t, chains)
            now.append(out)
            changed.append(did)
            lost.append(bool(_LOSS.search(out)) or bool(re.search(r"(?<!\S)\?{2,}(?!\S)", out)) or any("\x80" <= c <= "\x9f" for c in out))
            readings.append([{"word": a, "fixed": b, "chain": c, "odd": oddness(a) > 0} for a, b, c in words])
        return pa.StructArray.from_arrays([pa.array(now, pa.string()), pa.array(changed), pa.array(lost), pa.array(readings, kind)], names=["now", "changed", "lost", "readings"])

    apply = apply.asNondeterministic()  # else the filter below would run it a second time
    odd = lines.where(F.col("line").rlike(r"[^\x00-\x7F]|\?")).withColumn("r", apply("line")).select("line", "n", "r.*")
    odd = cut(odd.where("changed OR lost OR size(readings) > 0"))
    # single-byte readings: words against the counted words of the corpus
    asked = odd.where(F.size("readings") > 0).select("line", "n", F.explode("readings").alias("r")).select("line", "n", "r.*")
    words = lines.select(F.explode(F.split(F.lower("line"), _TOKENS)).alias("token"), "n").where("token <> ''").groupBy("token").agg(F.sum("n").alias("times"))
    wanted = asked.select(_plain_word("fixed").alias("token")).union(asked.select(F.lower("word").alias("token"))).distinct()
    known = words.join(wanted, "token", "left_semi")
    judged = (
        asked.join(known.select(F.col("token").alias("f"), F.col("times").alias("good")), _plain_word("fixed") == F.col("f"))
        .join(known.select(F.col("token").alias("w"), F.col("times").alias("bad")), F.lower("word") == F.col("w"), "left")
        .where("good > 3 * coalesce(bad, 0) OR odd AND good > coalesce(bad, 0)")
        .groupBy("line", "chain").agg(F.count("*").alias("met"), F.sum("good").alias("good"))
        .groupBy("line").agg(F.max_by("chain", F.struct("met", "good", "chain")).alias("chain"))
    )
    chosen = asked.join(judged, ["line", "chain"]).groupBy("line").agg(F.max("chain").alias("chain"))
    named = odd.join(chosen, "line", "left").where("changed OR lost OR chain IS NOT NULL")
    named = cut(named.withColumn("now", _read_again("now", "chain")).select("line", "now"))
    # lost characters: the clean line, or word, that agrees on the rest
    holes = named.where(F.col("now").rlike(r"[�?]")).select("line", "now")
    whole = holes.withColumn("skeleton", _bare("now"))
    clean = lines.where(F.col("line").rlike(r"[^\x00-\x7F]") & ~F.col("line").rlike(r"[�?\x{80}-\x{9F}]")).join(named.select("line"), "line", "left_anti")
    clean = clean.withColumn("skeleton", _bare("line")).select(F.col("line").alias("twin"), "n", "skeleton")
    line_twin = whole.where("skeleton IS NOT NULL").join(clean, (whole["skeleton"] == clean["skeleton"]) & (F.length("now") == F.length("twin"))).where(_fits("now", "twin")).groupBy("line").agg(F.max_by("twin", F.struct("n", "twin")).alias("twin"))
    torn = holes.select("line", F.explode(F.split("now", r"[\s.,;:!()\[\]_\"“”]+")).alias("word")).where(F.col("word").rlike(r"[�?]") & F.col("word").rlike(r"\p{L}"))
    torn = torn.select("line", "word").distinct().withColumn("skeleton", _bare_word("word"))
    lexicon = words.where(F.col("token").rlike(r"[^\x00-\x7F]") & ~F.col("token").rlike(r"[\x{80}-\x{9F}]")).withColumn("skeleton", _bare_word("token"))
    known_words = lexicon.where("skeleton IS NOT NULL")
    word_twin = torn.join(known_words, (torn["skeleton"] == known_words["skeleton"]) & (F.length("word") == F.length("token"))).where(_fits("word", "token")).groupBy("line", "word").agg(F.max_by("token", F.struct("times", "token")).alias("fixed"))
    word_twins = word_twin.groupBy("line").agg(F.collect_list(F.struct("word", "fixed")).alias("torn"))
    out = named.join(line_twin, "line", "left").join(word_twins, "line", "left")
    restored = F.coalesce("twin", _replaced("now", "torn"))
    return out.select("line", restored.alias("restored"), (~restored.rlike(r"[�\x{80}-\x{9F}]|[A-Za-z]\?[A-Za-z]")).alias("is_restored"))


@F.arrow_udf(T.StringType())
def _read_again(texts: pa.Array, chains: pa.Array) -> pa.Array:
    """The words of a line by the single-byte chain chosen for it: odd words, and all words of another alphabet."""

    def fix(m: re.Match, wrong: str, true: str) -> str:
        word = m[0]
        if word.isascii() or _poses(word):
            return word
        fixed = undo(word, wrong, true)
        return fixed if fixed is not None and _plausible(fixed) and oddness(fixed) == 0 and all(c.isalpha() or c < "\x80" or c in "’—–" for c in fixed.strip("“”")) else word

    out = []
    for t, c in zip(texts.to_pylist(), chains.to_pylist(), strict=True):
        if c:
            wrong, true = c.split(">")
            t = _WORD.sub(lambda m, wrong=wrong, true=true: fix(m, wrong, true), t)
        out.append(t)
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _replaced(texts: pa.Array, words: pa.Array) -> pa.Array:
    out = []
    for t, w in zip(texts.to_pylist(), words.to_pylist(), strict=True):
        for r in w or ():
            a, b = r["word"], r["fixed"]
            if a.isupper() and len(a) > 1:
                b = b.upper()
            elif a[:1].isupper() and a.lower() != a:
                b = b[:1].upper() + b[1:]
            t = re.sub(rf"(?<!\w){re.escape(a)}(?!\w)", lambda m, b=b: b, t)
        out.append(t)
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _bare(texts: pa.Array) -> pa.Array:
    s = [_skeleton(t) for t in texts.to_pylist()]
    return pa.array([x if sum(c.isalpha() for c in x) >= MIN_ASCII else None for x in s], pa.string())


@F.arrow_udf(T.StringType())
def _bare_word(texts: pa.Array) -> pa.Array:
    s = [_skeleton(t) for t in texts.to_pylist()]
    return pa.array([x if sum(c.isalpha() for c in x) >= 2 else None for x in s], pa.string())


@F.arrow_udf(T.BooleanType())
def _fits(torn: pa.Array, whole: pa.Array) -> pa.Array:
    """Whether ``whole`` agrees with ``torn`` in all but the lost characters, one for each mark."""
    out = []
    for a, b in zip(torn.to_pylist(), whole.to_pylist(), strict=True):
        out.append(len(a) == len(b) and all(y > "\x7f" if x in "?�" else x.lower() == y.lower() for x, y in zip(a, b, strict=True)))
    return pa.array(out, pa.bool_())


#: a time stamp in front of a lyric line
STAMP = r"^((?:\[[0-9:.]+\]\s?)*)"


_SUSPECT = r"[^\x00-\x7F]|\?"


def _lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at, stamp, line) of the lines of texts."""
    split = rows.select(*keys, F.posexplode(F.split("original", "\n")).alias("at", "raw"))
    return split.select(*keys, "at", F.regexp_extract("raw", STAMP, 1).alias("stamp"), F.regexp_replace(F.regexp_replace("raw", STAMP, ""), "\r$", "").alias("line"))


def garbled_fields(df: DataFrame, keys: Sequence[str], text: str, min_share: float = MIN_SHARE, chains: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(keys, original, restored, is_restored) of each garbled text of ``df``.

    Texts are taken apart into lines (time stamps of lyrics stay in front), so partly garbled
    texts are found and repaired line by line. Null and empty texts give no row, repeated keys one row,
    an empty table an empty result; other columns are not read. ``chains`` skips the learning.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(text).alias("original")).where("original <> ''")
    # all texts give words and twins; only those with other characters than ASCII, or question marks, can be garbled
    lines = _lines(base.distinct(), keys).where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).persist()
    fixed = cut(repair_lines(lines, learn(lines, min_share) if chains is None else chains))
    lines.unpersist()
    rows = base.where(F.col("original").rlike(_SUSPECT)).dropDuplicates(keys)
    hits = _lines(rows, keys).where(F.col("line").rlike(_SUSPECT)).join(fixed, "line").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", F.concat("stamp", "restored")))).alias("new"), F.min("is_restored").alias("is_restored"))
    out = rows.join(hits, keys)
    parts = F.transform(F.split("original", "\n"), lambda x, i: F.coalesce(F.concat(F.try_element_at("new", i), F.when(x.endswith("\r"), "\r").otherwise("")), x))
    return out.select(*keys, "original", F.array_join(parts, "\n").alias("restored"), "is_restored")
