"""One consistent form for text that looks the same but differs in its characters.

The form: composed letters of ordinary shape and width, one script per word, plain ASCII space,
hyphen and apostrophe, nothing invisible. Letter case and the number of plain spaces are left
alone. Look-alike letters are replaced only in words that mix scripts (or stand alone as a foreign
look-alike in a line of another script), towards the script that dominates the word, and only
when the result exists in the vocabulary of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that stand for a plain apostrophe or hyphen, and letters of one script that look like one of another.
APOSTROPHES = "‘’‛′ʹʻʼˈ´`＇｀ꞌ"
HYPHENS = "‐‑‒−⁃﹣－"
CYRILLIC_AS_LATIN = dict(zip("аеорсухіјѕһԁԛԝѵїёАВЕКМНОРСТУХІЈЅҺԚԜѴЇЁҮ", "aeopcyxijshdqwvïëABEKMHOPCTYXIJSHQWVÏËY", strict=True))
GREEK_AS_LATIN = dict(zip("οναιρυκχγητωεϲϳόίύΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ovaipukxyntwecjóíúABEZHIKMNOPTYXC", strict=True))
LATIN_AS_CYRILLIC = {**dict(zip("aeopcyxABEKMHOPCTYXëË", "аеорсухАВЕКМНОРСТУХёЁ", strict=True)), "k": "к", "i": "і", "j": "ј", "s": "ѕ"}

_INVISIBLE_BLOCKS = ((0xFE00, 0xFE0F), (0xE0000, 0xE01EF), (0x115F, 0x1160), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0x180B, 0x180E), (0x034F, 0x034F))


def _table() -> dict[int, str]:
    """Single characters to their ordinary form, from the character database."""
    out: dict[int, str] = {}
    for code in [*range(0x80, 0xFFFF), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1AD), *range(0xE0000, 0xE01F0)]:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or any(a <= code <= b for a, b in _INVISIBLE_BLOCKS):
            out[code] = ""
        elif kind in ("Zs", "Zl", "Zp"):
            out[code] = " "
        elif kind[0] in "LN" and c not in "ªº" and kind != "No" or 0xFF00 <= code <= 0xFFEF:
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and unicodedata.normalize("NFC", c) != plain or 0xFF00 <= code <= 0xFFEF:
                out[code] = plain
    out |= dict.fromkeys(map(ord, APOSTROPHES), "'") | dict.fromkeys(map(ord, HYPHENS), "-")
    del out[ord("`")]
    return out


_TABLE: dict[int, str] = {}
#: a variation selector behind a symbol only chooses how an emoji is drawn
_EMOJI_STYLE = re.compile("(?<=[←-⯿\U0001f000-\U0001faff©®])[︎️]|‍(?=[♀♂⚕-➿\U0001f000-\U0001faff])")


def ordinary(text: str) -> str:
    """``text`` with ordinary characters: everything but look-alike letters of other scripts."""
    if text.isascii():
        return text
    if not _TABLE:
        _TABLE.update(_table())
    held = _EMOJI_STYLE.sub(lambda m: chr(0xF0000 + ord(m[0]) % 0x10000), text) if _EMOJI_STYLE.search(text) else text
    out = unicodedata.normalize("NFC", held.translate(_TABLE))
    return re.sub("[\U000f0000-\U000fffff]", lambda m: chr(ord(m[0]) - 0xF0000), out) if held is not text else out


_LATIN, _CYRILLIC, _GREEK = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "Ѐ-ԯ", "Ͱ-Ͽἀ-῿"
_WORD = re.compile(f"[{_LATIN}{_CYRILLIC}{_GREEK}]+")
_FOREIGN = re.compile(f"[{_CYRILLIC}{_GREEK}]")
_SCRIPTS = (re.compile(f"[{_LATIN}]"), re.compile(f"[{_CYRILLIC}]"), re.compile(f"[{_GREEK}]"))
_TO_LATIN = str.maketrans(CYRILLIC_AS_LATIN | GREEK_AS_LATIN)
_TO_CYRILLIC = str.maketrans(LATIN_AS_CYRILLIC | {g: LATIN_AS_CYRILLIC[x] for g, x in GREEK_AS_LATIN.items() if x in LATIN_AS_CYRILLIC})
_POSING = {**dict.fromkeys(CYRILLIC_AS_LATIN, 1), **dict.fromkeys(GREEK_AS_LATIN, 2), **dict.fromkeys(LATIN_AS_CYRILLIC, 0)}


def _count(word: str) -> list[int]:
    return [len(s.findall(word)) for s in _SCRIPTS]


def _sure(word: str) -> list[int]:
    """Letters of each script that pose as no other."""
    out = [0, 0, 0]
    for c in word:
        if c not in _POSING:
            for k, s in enumerate(_SCRIPTS):
                if s.match(c):
                    out[k] += 1
    return out


def script_repairs(text: str) -> list[tuple[str, str]]:
    """(word, repaired word) of each word of ``text`` that mixes scripts and can be brought to one.

    The script that dominates a word is that of most of its letters that can't pose as another,
    then of most letters, then that of the line. A word all of foreign look-alikes counts as mixed if
    the rest of the line is in another script. Words that stay mixed are left out.
    """
    if not _FOREIGN.search(text):
        return []
    words = _WORD.findall(text)
    line = [0, 0, 0]
    counted = []
    for w in words:
        counted.append(_count(w))
        line = [a + b for a, b in zip(line, _sure(w), strict=True)]
    around = line.index(max(line)) if max(line) else 0
    out = []
    for w, n in zip(words, counted, strict=True):
        kinds = [k for k in range(3) if n[k]]
        if len(kinds) > 1:
            sure = _sure(w)
            most = max((sure[k], n[k], k == around, -k) for k in (0, 1))
            to = -most[3]
        elif kinds and kinds[0] and kinds[0] != around and around < 2 and max(line) and all(c in _POSING for c in w):
            to = around
        elif kinds == [0] and around == 1 and len(w) <= 2 and all(c in LATIN_AS_CYRILLIC for c in w):
            to = 1
        else:
            continue
        fixed = w.translate(_TO_LATIN if to == 0 else _TO_CYRILLIC)
        if fixed != w and sum(map(bool, _count(fixed))) == 1:
            out.append((w, fixed))
    return out


def folded(text: str) -> str:
    """The form for comparisons: ordinary characters, one script per word, lower case."""
    out = ordinary(text)
    if not out.isascii():
        for word, fixed in script_repairs(out):
            out = re.sub(rf"(?<![{_LATIN}{_CYRILLIC}{_GREEK}]){re.escape(word)}(?![{_LATIN}{_CYRILLIC}{_GREEK}])", fixed, out)
    return out.casefold()


_REPAIR = T.StructType([T.StructField("word", T.StringType()), T.StructField("fixed", T.StringType())])
_CHECKED = T.StructType([T.StructField("plain", T.StringType()), T.StructField("repairs", T.ArrayType(_REPAIR))])


@F.arrow_udf(_CHECKED)
def _checked(texts: pa.Array) -> pa.Array:
    plains, repairs = [], []
    for t in texts.to_pylist():
        plain = None if t is None else ordinary(t)
        plains.append(plain)
        repairs.append([] if plain is None else [{"word": a, "fixed": b} for a, b in script_repairs(plain)])
    kind = pa.list_(pa.struct([("word", pa.string()), ("fixed", pa.string())]))
    return pa.StructArray.from_arrays([pa.array(plains, pa.string()), pa.array(repairs, kind)], names=["plain", "repairs"])


_checked = _checked.asNondeterministic()  # else a filter on its result would run it a second time


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(token, n) of all lower-case words of a text column, counted over all rows."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{N}]+")).alias("token"))
    return words.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def unify(df: DataFrame, keys: Sequence[str], text: str, corpus: DataFrame | None = None) -> DataFrame:
    """(keys, original, unified) of each text that isn't in the consistent form.

    ``corpus`` is a one-column DataFrame of texts whose words make the vocabulary (``text`` itself by
    default). Null and empty texts are in the form; rows repeated under the same keys give one
    row; other columns are not read. Scripts are repaired word by word where the repaired word
    stands in the vocabulary; a word whose repair is unknown stays as it is, but its text is
    still listed, as it isn't in the form.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(text).alias("original"))
    whole = corpus if corpus is not None else rows.select("original")
    odd = rows.where(F.col("original").rlike(r"[^\x00-\x7F]")).dropDuplicates(keys)
    checked = odd.withColumn("c", _checked("original")).where((F.col("c.plain") != F.col("original")) | (F.size("c.repairs") > 0))
    checked = checked.select(*keys, "original", F.col("c.plain").alias("plain"), F.col("c.repairs").alias("repairs")).persist(StorageLevel.DISK_ONLY)
    asked = checked.where(F.size("repairs") > 0).select(F.explode("repairs").alias("r")).select(F.lower("r.fixed").alias("token")).distinct()
    known = vocabulary(whole, whole.columns[0]).join(asked, "token", "left_semi").select("token")
    words = checked.where(F.size("repairs") > 0).select(*keys, F.explode("repairs").alias("r")).withColumn("token", F.lower("r.fixed"))
    confirmed = words.join(known, "token").groupBy(*keys).agg(F.collect_set("r").alias("confirmed"))  # words of one text
    return checked.join(confirmed, keys, "left").select(*keys, "original", _rewritten("plain", "confirmed").alias("unified"))


@F.arrow_udf(T.StringType())
def _rewritten(plain: pa.Array, confirmed: pa.Array) -> pa.Array:
    out = []
    for p, repairs in zip(plain.to_pylist(), confirmed.to_pylist(), strict=True):
        if repairs and p is not None:
            fixed = {r["word"]: r["fixed"] for r in repairs}
            p = _WORD.sub(lambda m, fixed=fixed: fixed.get(m[0], m[0]), p)
        out.append(p)
    return pa.array(out, pa.string())


def unified(text: str | Column) -> Column:
    """``text`` in ordinary characters, without the vocabulary (no look-alike repair)."""
    return _checked(F.col(text) if isinstance(text, str) else text)["plain"]
