"""Text rules as column expressions: display form, similarity, tags, clocks, receipts, sizes, sources."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.functions.speech import PART_NAMES, fold, number_words, tokens_of

# Language codes; lyric tag families; hosts; marks of an ended and of a running line.
#: ISO 639: each two-letter code with its three-letter code, and the bibliographic one where that differs
ISO_639 = """
aa aar, ab abk, ae ave, af afr, ak aka, am amh, an arg, ar ara, as asm, av ava, ay aym, az aze, ba bak, be bel, bg bul, bi bis,
bm bam, bn ben, bo bod tib, br bre, bs bos, ca cat, ce che, ch cha, co cos, cr cre, cs ces cze, cu chu, cv chv, cy cym wel,
da dan, de deu ger, dv div, dz dzo, ee ewe, el ell gre, en eng, eo epo, es spa, et est, eu eus baq, fa fas per, ff ful, fi fin,
fj fij, fo fao, fr fra fre, fy fry, ga gle, gd gla, gl glg, gn grn, gu guj, gv glv, ha hau, he heb, hi hin, ho hmo, hr hrv,
ht hat, hu hun, hy hye arm, hz her, ia ina, id ind, ie ile, ig ibo, ii iii, ik ipk, io ido, is isl ice, it ita, iu iku, ja jpn,
jv jav, ka kat geo, kg kon, ki kik, kj kua, kk kaz, kl kal, km khm, kn kan, ko kor, kr kau, ks kas, ku kur, kv kom, kw cor,
ky kir, la lat, lb ltz, lg lug, li lim, ln lin, lo lao, lt lit, lu lub, lv lav, mg mlg, mh mah, mi mri mao, mk mkd mac, ml mal,
mn mon, mr mar, ms msa may, mt mlt, my mya bur, na nau, nb nob, nd nde, ne nep, ng ndo, nl nld dut, nn nno, no nor, nr nbl,
nv nav, ny nya, oc oci, oj oji, om orm, or ori, os oss, pa pan, pi pli, pl pol, ps pus, pt por, qu que, rm roh, rn run,
ro ron rum, ru rus, rw kin, sa san, sc srd, sd snd, se sme, sg sag, si sin, sk slk slo, sl slv, sm smo, sn sna, so som,
sq sqi alb, sr srp, ss ssw, st sot, su sun, sv swe, sw swa, ta tam, te tel, tg tgk, th tha, ti tir, tk tuk, tl tgl, tn tsn,
to ton, tr tur, ts tso, tt tat, tw twi, ty tah, ug uig, uk ukr, ur urd, uz uzb, ve ven, vi vie, vo vol, wa wln, wo wol, xh xho,
yi yid, yo yor, za zha, zh zho chi, zu zul
"""
LANGUAGE_ALIASES = {two: " ".join(threes) for two, *threes in (entry.split() for entry in ISO_639.split(","))}
TAG_FAMILIES = ("unsyncedlyrics", "syncedlyrics", "lyrics")
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")
SENTENCE_ENDS, CONTINUATIONS = ".!?…", ",-–—…;:"


def display_line(text: Column, limit: int = 200) -> Column:
    """Unprintable characters as spaces, white space collapsed, at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\p{C}\p{Z}]+", " ")), 1, limit)


def plain_text(text: Column) -> Column:
    """A line without tags, its common entities resolved, white space collapsed."""
    bare = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def shared_prefix(a: Column, b: Column, most: int = 32) -> Column:
    n = F.least(F.length(a), F.length(b), F.lit(most))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: (i <= n) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def similarity(a: Column, b: Column, most: int = 32) -> Column:
    """0.75 of the edit similarity and 0.25 of the shared prefix over the first ``most`` characters; 1 for equal, 0 for empty."""
    x, y = F.substring(a, 1, most), F.substring(b, 1, most)
    longest, total = F.greatest(F.length(x), F.length(y)), F.length(x) + F.length(y)
    near = F.lit(0.75) * (1 - F.levenshtein(x, y) / longest) + F.lit(0.25) * 2 * shared_prefix(x, y, most) / total
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(near)


def pair_score(sim: Column) -> Column:
    """Score of aligning two tokens: 2 gaps saved plus 4.4 for each point of similarity over one half."""
    return 2 * F.lit(-0.6) + F.lit(4.4) * (sim - F.lit(0.5))


def letter_mask(text: Column) -> Column:
    """64-bit sketch of the characters of a text."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.expr("1L") * F.pow(F.lit(2.0), c % 63).cast("long")))


def language_base(tag: Column) -> Column:
    """Two-letter base of a language tag; an unknown three-letter base stays, anything else gives an empty string."""
    base = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    alias = F.create_map(*[F.lit(x) for two, threes in LANGUAGE_ALIASES.items() for three in threes.split() for x in (three, two)])
    return F.coalesce(F.try_element_at(alias, base), base, F.lit(""))


def tag_family(key: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(key)), r"^(unsyncedlyrics|syncedlyrics|lyrics)(?:[-_].*)?$", 1)


def tag_language(key: Column) -> Column:
    tail = F.regexp_extract(F.lower(F.trim(key)), r"^(?:unsyncedlyrics|syncedlyrics|lyrics)[-_]([a-z]{2,3}(?:-(?:[a-z]{4}|[a-z]{2}|[0-9]{3}))?)$", 1)
    return F.when(tail == "", "unknown").otherwise(tail)


def clock_seconds(clock: Column) -> Column:
    """Seconds of ``[h:]mm:ss[.,fff]``; null if it isn't one."""
    at = lambda g: F.regexp_extract(clock, r"^(?:(\d{1,3}):)?(\d{1,3}):(\d{1,2}(?:[.,]\d{1,3})?)$", g)
    seconds = F.coalesce(F.nullif(at(1), F.lit("")).cast("double"), F.lit(0.0)) * 3600 + at(2).try_cast("double") * 60 + F.replace(at(3), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(at(2) != "", seconds)


def clock_text(seconds: Column) -> Column:
    """``mm:ss.fff``, rounded before it is split so that 59.9996 reads 01:00.000."""
    ticks = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    minutes, rest = F.floor(ticks / 60000).cast("long"), ticks % 60000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.when(minutes < 10, two(minutes)).otherwise(minutes.cast("string")), F.lit(":"), two(F.floor(rest / 1000).cast("long")), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"))


def file_size(text: Column) -> Column:
    """Bytes of ``512M``-like sizes; null beyond 1 PiB, for zero or another form."""
    m = lambda g: F.regexp_extract(F.lower(F.trim(text)), r"^(\d+(?:\.\d+)?)([kmgt]?)$", g)
    power = F.when(m(2) == "", F.lit(1.0))
    for k, unit in enumerate("kmgt", 1):
        power = power.when(m(2) == unit, F.lit(float(1024**k)))
    value = m(1).try_cast("double") * power
    return F.when((m(1) != "") & (value > 0) & (value <= float(1024**5)), F.floor(value))


def size_label(n: Column) -> Column:
    """A whole number of G, M or K where it is one, else bytes."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for unit, scale in (("K", 1024), ("M", 1024**2), ("G", 1024**3)):
        out = F.when((n >= scale) & (n % scale == 0), F.concat((n / scale).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def redacted(text: Column, limit: int = 500) -> Column:
    """URLs and home folders taken out, then the display rule."""
    out = F.regexp_replace(text, r"https?://\S+", "<redacted-url>")
    return display_line(F.regexp_replace(out, r"/(?:home|Users)/[^/\s]+", "<home>"), limit)


def source_kind(value: Column) -> Column:
    """url, file-url, path, or refused: what one string given as a source is."""
    return (
        F.when((F.length(value) > 4096) | value.rlike(r"\p{C}") | (F.trim(value) == ""), "refused").when(value.rlike(r"(?i)^https://"), "url").when(value.rlike(r"(?i)^file://"), "file-url")
        .when(value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), "refused").otherwise("path")
    )


def url_verdict(url: Column) -> Column:
    """ok, or why a URL is refused: scheme, host, credentials, port or playlist."""
    host = F.rtrim(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)", 1)))
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    listed, video = query.rlike(r"(^|&)list=[^&]"), query.rlike(r"(^|&)v=[^&]")
    playlist = F.regexp_replace(F.lower(path), "/+", "/").rlike("^/playlist/?$") | (listed & ~video & ((host != "youtu.be") | path.rlike("^/watch/?$")))
    return (
        F.when(~url.rlike(r"^https://"), "scheme").when(url.rlike(r"^https://[^/]*@"), "credentials").when(url.rlike(r"^https://[^/?#]*:(?!443(?:[/?#]|$))\d+"), "port")
        .when(~host.isin(*VIDEO_HOSTS), "host").when(playlist, "playlist").otherwise("ok")
    )


def is_marker(line: Column, names: Sequence[str] = PART_NAMES) -> Column:
    """Whether a line names a part of a song: any ``[...]``, or ``(...)`` that begins with one of the part ``names``."""
    return line.rlike(r"^\[[^\[\]]*\]$") | F.lower(line).rlike(rf"^\(\s*(?:{'|'.join(names)})(?![\p{{L}}\p{{N}}'])[^()]*\)$")


@F.arrow_udf(T.StringType())
def folded(texts: pa.Array) -> pa.Array:
    """Accents and case folded, apostrophes unified, punctuation as spaces: the form for exact comparisons."""
    return pa.array([None if t is None else " ".join("".join(c if c.isalnum() else " " for c in fold(t)).split()) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def tokens(texts: pa.Array) -> pa.Array:
    """Comparison tokens of ``speech.tokens_of``; a null text gives null."""
    return pa.array([None if t is None else tokens_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.IntegerType())
def display_width(texts: pa.Array) -> pa.Array:
    """Terminal cells of a text: two for wide characters, none for combining ones."""
    one = lambda c: 0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Me", "Mn") else 2 if unicodedata.east_asian_width(c) in "WF" else 1
    return pa.array([None if t is None else sum(map(one, t)) for t in texts.to_pylist()], pa.int32())


@F.arrow_udf(T.StringType())
def spoken_number(digits: pa.Array) -> pa.Array:
    return pa.array([" ".join(number_words(t)) if t and t.isdigit() and t.isascii() else None for t in digits.to_pylist()], pa.string())


def stored_report(document: Column) -> Column:
    """The alignment report of a JSON document: a struct whose every part is in range, or null."""
    r = F.from_json(document, "matched_fraction double, interpolated_words long, mean_displacement double, usable boolean")
    finite = lambda c: ~F.isnan(c) & (c < float("inf"))
    fine = finite(r["matched_fraction"]) & r["matched_fraction"].between(0.0, 1.0) & (r["interpolated_words"] >= 0) & finite(r["mean_displacement"]) & (r["mean_displacement"] >= 0) & r["usable"].isNotNull()
    return F.when(fine, r)


def stays_inside(path: Column) -> Column:
    """Whether a path is relative and holds no empty, ``.`` or ``..`` part and no back slash or control character."""
    return ~path.rlike(r"^$|^/|/$|//|(?:^|/)\.{1,2}(?:/|$)|[\\\x00-\x1f]")
