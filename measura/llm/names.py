"""Variant spellings of names, linked to a register of the names meant.

Blocking: every token of a name is indexed under all its suffixes of a minimum length, so a typo
near the front, a dropped initial or two words written as one still leave a common suffix. A
suffix shared by too many register entries is refined with the first letters of the other tokens, and one
still too common with their first two. Pairs that meet are compared by the ratio of their longest common subsequence,
read token by token; the best ratio decides, by a margin, and an exact account of every token may veto it. Short forms of
first names are learned from the names themselves: where all of a spelling but one token fits an entry, that token votes
for what it stands for.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.llm.runs import within
from measura.llm.unify import folded
from measura.session import cut

#: shortest suffix that is indexed (two letters for scripts that write a word in few signs)
MIN_SUFFIX = 4
#: register entries that may share a suffix before it is refined, and a refined one before it is refined again
COMMON = 12
COMMON_REFINED = 60
#: least ratio of the longest common subsequence: of whole names to be looked at, of names read token by token to be linked; and its margin
LEAST_RATIO, LINK_RATIO, MARGIN = 0.5, 0.7, 0.005
#: entries of the register whose spellings must agree on what a short form stands for, as a multiple of those of its next reading too
LEAST_ENTRIES, LEAST_LEAD = 3, 2.0

# Words that carry no name, short forms of ensemble words, and common short forms of first names.
EMPTY_WORDS = frozenset("the and n und et y e feat ft".split())
SHORT_WORDS = {"bros": "brothers", "bro": "brothers", "qt": "quartet", "qtet": "quartet", "qrt": "quartet", "quart": "quartet", "orch": "orchestra", "ork": "orchestra", "ens": "ensemble", "ensem": "ensemble", "coll": "collective", "col": "collective", "exp": "experience", "xp": "experience", "grp": "group", "trio": "trio", "3": "trio"}
SHORT_NAMES = {
    "alexander": "alex sandy sasha xander", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate", "charles": "charlie chuck", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dorothy": "dot dotty", "edward": "ed eddie ned ted", "elizabeth": "beth betty eliza lizzie liz", "eugene": "gene", "francis": "frank", "frederick": "fred freddie freddy",
    "gerald": "gerry jerry", "gregory": "greg", "henry": "hal harry hank", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "katherine": "kate kathy katie kit kitty",
    "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny", "margaret": "maggie meg peggy", "martha": "patty", "matthew": "matt", "michael": "mick mickey mike", "nathaniel": "nat nate", "nicholas": "nick nicky", "pamela": "pam",
    "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becca becky", "richard": "dick rich rick", "robert": "bob bobby rob robbie bert", "ronald": "ron", "samuel": "sam sammy", "stephen": "steve",
    "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky", "walter": "walt", "william": "bill billy will willy",
    "dolores": "lola", "francisco": "curro fran kiko paco pancho", "guadalupe": "lupe lupita", "ignacio": "nacho", "jose": "pepe", "rosario": "charo", "giuseppe": "beppe peppe pino", "luigi": "gino", "johannes": "hannes hans", "josef": "sepp",
    "aleksandr": "sasha shura", "dmitri": "dima mitya", "ekaterina": "katya katia", "ivan": "vanya", "mikhail": "misha", "nikolai": "kolya", "vladimir": "volodya vova", "katarzyna": "kasia", "malgorzata": "gosia", "zofia": "zosia",
}
_FULL_NAMES = {short: [full for full, shorts in SHORT_NAMES.items() if short in shorts.split()] for shorts in SHORT_NAMES.values() for short in shorts.split()}
_SHORT_FOR = {(short, full) for full, shorts in SHORT_NAMES.items() for short in shorts.split()}
_EXPANDED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe", "ñ": "ny", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l"})
_SINGLE = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ı": "i"})


@lru_cache(200_000)
def bare(token: str) -> str:
    """Lower-case letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", token.translate(_SINGLE)) if not unicodedata.combining(c))


def name_tokens(name: str) -> list[str]:
    """The words of a folded name, without words that carry no name."""
    return [w for w in re.findall(r"[^\W_]+", name.replace("'", "").replace("’", "")) if w not in EMPTY_WORDS]


def suffixes(tokens: list[str], least: int = MIN_SUFFIX) -> list[str]:
    """All suffixes of the tokens, of the names that common short forms stand for, and of both without their last letters.

    A suffix of a shortened token is marked with the letters cut off, so that a typo in an ending leaves one.
    """
    out = set()
    for t in {x for t in map(bare, tokens) for x in (t, *_FULL_NAMES.get(t, ()))}:
        low = 2 if any(c > "⺀" for c in t) else least
        out.update(t[i:] for i in range(len(t) - low + 1))
        if len(t) < low:
            out.add(t)
        for cut in range(1, len(t) - low + 1):
            stem = t[:-cut]
            out.update(f"{stem[i:]}~" for i in range(min(2, len(stem) - low + 1)))
    return sorted(out)


def subsequence_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths (bit-parallel rows)."""
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _token_cost(s: str, a: str) -> float | None:
    """What it takes to read ``s`` as ``a``; None if it can't be."""
    if s == a:
        return 0.0
    x, y = bare(s), bare(a)
    if x == y or s.translate(_EXPANDED) == a.translate(_EXPANDED) or x == bare(a.translate(_EXPANDED)):
        return 0.1
    if (x, y) in _SHORT_FOR:
        return 0.5
    if SHORT_WORDS.get(x) == y:
        return 0.3
    if len(x) == 1:
        return 1.0 if y[:1] == x else None
    if len(y) > 3 and len(x) > 2:
        if within(x, y, 1) or within(s, a.translate(_EXPANDED), 1):
            return 1.0
        if len(y) > 5 and within(x, y, 2):
            return 2.2
    if any(full == y and len(f) > 2 and within(x, f, 1) for f, full in SHORT_WORDS.items()):
        return 1.3
    return None


def assigned(costs: list[list[float]]) -> list[int]:
    """The column given to each row so that the costs add up to the least (rows don't outnumber columns); shortest augmenting paths."""
    n, m = len(costs), len(costs[0]) if costs else 0
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at, least, seen = i, 0, [float("inf")] * (m + 1), [False] * (m + 1)
        while owner[at]:
            seen[at], row = True, owner[at]
            for j in range(1, m + 1):
                if not seen[j] and (c := costs[row - 1][j - 1] - u[row] - v[j]) < least[j]:
                    least[j], way[j] = c, at
            to = min((j for j in range(1, m + 1) if not seen[j]), key=least.__getitem__)
            step = least[to]
            for j in range(m + 1):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


_UNKNOWN = 100.0


class Account(NamedTuple):
    """How a spelling reads as an entry: the cost, the ratio of the longest common subsequence of what is read with the
    entry, and the one short form it takes that is not known (spelt, meant), if any."""

    cost: float
    ratio: float
    short: tuple[str, str] | None = None


def explain(spelling: str, act: str) -> Account | None:
    """How ``spelling`` reads as ``act`` (both folded); None if more than one token, or one beside no whole word, stays unexplained.

    Tokens may be reordered, shortened, misspelt or run together; a middle initial may be added. Letters that initials and known short forms
    leave out count as read.
    """
    if " ".join(spelling.split()) == " ".join(act.split()):
        return Account(0.0, 1.0)
    want = name_tokens(act)
    have: list[str] = []
    todo = name_tokens(spelling)[::-1]
    while todo:  # a token that begins or ends with a whole word of the entry is taken apart there
        s = todo.pop()
        x, rest = bare(s), None
        for a in sorted(want, key=len, reverse=True):
            y = bare(a)
            if len(x) > len(y) + 1 and len(y) > 2:
                if x.startswith(y):
                    rest = [s[: len(y)], s[len(y) :]] if len(s) == len(x) else [a, x[len(y) :]]
                elif x.endswith(y):
                    rest = [s[: -len(y)], s[-len(y) :]] if len(s) == len(x) else [x[: -len(y)], a]
                if rest:
                    break
        if rest is None and x.startswith("the") and len(x) > 6 and any(within(x[3:], bare(a), 1) for a in want):
            rest = [s[3:]]
        if rest:
            todo += [t for t in rest[::-1] if t not in EMPTY_WORDS]
        else:
            have.append(s)
    joined = 0.2 if len(have) != len(name_tokens(spelling)) else 0.0
    # words of the register entry that the spelling runs together or tears apart
    if len(have) != len(want) and "".join(map(bare, have)) == "".join(map(bare, want)):
        return Account(0.2, 1.0)
    if not want or len(have) < len(want) or len(have) > len(want) + 1:
        whole, goal = "".join(map(bare, have)), "".join(map(bare, want))
        return Account(1.2, subsequence_ratio(whole, goal)) if len(goal) > 7 and len(have) <= len(want) and within(whole, goal, 1) else None
    known = [[_token_cost(s, a) for s in have] for a in want]
    order = assigned([[_UNKNOWN if c is None else c for c in row] for row in known])
    strange = [(have[s], a) for a, s, row in zip(want, order, known, strict=True) if row[s] is None]
    left = [have[s] for s in range(len(have)) if s not in order]
    if len(strange) > 1 or any(len(x) > 1 for x in left) or left and len(want) < 2 or all(len(s) == 1 for s in have):
        return None
    cost = sum(row[s] for s, row in zip(order, known, strict=True) if row[s] is not None) + 0.4 * len(left)
    short = None
    if strange:
        x, y = bare(strange[0][0]), bare(strange[0][1])
        solid = any(len(have[s]) > 2 and row[s] is not None for s, row in zip(order, known, strict=True))
        if not solid or len(x) < 2 or len(y) < 3 or cost > 1.5:
            return None
        short, cost = (x, y), cost + 0.5
    if cost > 3.5:
        return None
    read = [bare(a) if len(have[s]) == 1 or row[s] is None or row[s] in (0.1, 0.3, 0.5) else bare(have[s]) for a, s, row in zip(want, order, known, strict=True)]
    return Account(max(cost + joined, 0.05), subsequence_ratio("".join(read), "".join(map(bare, want))), short)  # other words in between, or another order, are another spelling


_NAMED = T.StructType([T.StructField("name", T.StringType()), T.StructField("suffixes", T.ArrayType(T.StringType())), T.StructField("initials", T.ArrayType(T.StringType())), T.StructField("heads", T.ArrayType(T.StringType()))])


@F.arrow_udf(_NAMED)
def _indexed_udf(names: pa.Array) -> pa.Array:
    folds, ends, firsts, heads = [], [], [], []
    for n in names.to_pylist():
        f = " ".join(folded(n).split()) if n is not None else ""
        tokens = name_tokens(f)
        folds.append(f)
        ends.append(suffixes(tokens))
        firsts.append(sorted({bare(t)[:1] for t in tokens}))
        heads.append(sorted({bare(t)[:2] for t in tokens}))
    strings = pa.list_(pa.string())
    return pa.StructArray.from_arrays([pa.array(folds, pa.string()), pa.array(ends, strings), pa.array(firsts, strings), pa.array(heads, strings)], names=["name", "suffixes", "initials", "heads"])


_indexed = _indexed_udf.asNondeterministic()  # else its fields would be taken from several runs


_ACCOUNT = T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("ratio", T.DoubleType()), T.StructField("short", T.StringType()), T.StructField("full", T.StringType())])


@F.arrow_udf(_ACCOUNT)
def _account(spellings: pa.Array, acts: pa.Array) -> pa.Array:
    out: list[tuple] = []
    for s, a in zip(spellings.to_pylist(), acts.to_pylist(), strict=True):
        x, y = bare(s).replace(" ", ""), bare(a).replace(" ", "")
        near = subsequence_ratio(x, y)
        if near < LEAST_RATIO:
            near = subsequence_ratio("".join(sorted(map(bare, name_tokens(s)))), "".join(sorted(map(bare, name_tokens(a)))))
        told = explain(s, a) if near >= LEAST_RATIO else None
        out.append((None,) * 4 if told is None else (told.cost, told.ratio, *(told.short or (None, None))))
    kinds = (pa.float64(), pa.float64(), pa.string(), pa.string())
    columns = zip(*out, strict=True) if out else ((),) * 4
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_ACCOUNT.names)


_account = _account.asNondeterministic()  # else the filter on its result would run it a second time


def short_forms(accounts: DataFrame, register_tokens: DataFrame, least_entries: int = LEAST_ENTRIES, least_lead: float = LEAST_LEAD) -> DataFrame:
    """(short, full) learned from ``accounts`` (rk, short, full: readings that take one unknown short form).

    ``least_entries`` different entries must have a spelling in which all but this token fits, and ``least_lead`` times as many
    as for any other reading of it. A word of the register (``token``) is a name of its own.
    """
    votes = accounts.where("cost <= 0.9").join(register_tokens.select(F.col("token").alias("short")), "short", "left_anti").groupBy("short", "full").agg(F.count_distinct("rk").alias("entries"))
    w = W.partitionBy("short").orderBy(F.desc("entries"), "full")  # the readings of one token
    ranked = votes.withColumns({"place": F.row_number().over(w), "next": F.coalesce(F.lead("entries").over(w), F.lit(0))})
    return ranked.where((F.col("place") == 1) & (F.col("entries") >= least_entries) & (F.col("entries") >= F.col("next") * least_lead)).select("short", "full")


def link_names(names: DataFrame, name: str, register: DataFrame, register_key: str, register_name: str, known: DataFrame | None = None) -> DataFrame:
    """(original, register_key, cost) of each distinct ``name`` that means one entry of ``register``.

    cost 0 stands for the same name but for case, spaces and look-alike characters. ``known`` (short, full) adds short forms to those
    learned and to the common ones of ``SHORT_NAMES``. Null and blank names, names that fit no
    entry and names that fit two equally well give no row. Other columns are not read; repeated
    rows count once; empty inputs give an empty result. Distinct names meet the register only under a common
    suffix; no pair of two names is formed.
    """
    spelt = names.select(F.col(name).alias("original")).where(F.trim("original") != "").distinct()
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # names are short: by their bytes, all would go to one task
    spelt = spelt.repartition(tasks).withColumn("x", _indexed("original")).select("original", "x.*")
    acts = register.select(F.col(register_key).alias("rk"), F.col(register_name).alias("rn")).where(F.trim("rn") != "").dropDuplicates(["rk"]).withColumn("x", _indexed("rn"))
    acts = cut(acts.select("rk", F.col("x.name").alias("act"), "x.suffixes", "x.initials", "x.heads"))  # read several times below
    pairs = spelt.select("original", F.col("name").alias("spelling"), F.explode(_keys()).alias("block")).join(index(acts), "block").select("original", "spelling", "rk", "act").distinct().repartition(tasks)
    told = cut(pairs.withColumn("a", _account("spelling", "act")).select("original", "rk", "a.*").where("cost IS NOT NULL"))
    tokens = acts.select(F.explode(F.split("act", r"[^\p{L}\p{M}\p{N}]+")).alias("token")).distinct()
    whole = told.where("short IS NULL")
    partly = told.where("short IS NOT NULL").join(whole.select("original").distinct(), "original", "left_anti")  # no entry explains all of the spelling
    learned = short_forms(partly, tokens)
    if known is not None:
        learned = learned.union(known.select("short", "full")).distinct()
    sure = whole.unionByName(partly.join(learned, ["short", "full"]).select(told.columns)).where(F.col("ratio") >= LINK_RATIO)
    fits = F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("unlike"), "cost", "rk")))  # the entries that fit one name
    best = sure.groupBy("original").agg(fits.alias("fits")).withColumns({"b": F.col("fits")[0], "c": F.try_element_at("fits", F.lit(2))})
    clear = F.col("c").isNull() | (F.col("c.unlike") > F.col("b.unlike") + MARGIN) | (F.col("c.cost") > F.col("b.cost") + 0.05)
    return best.where(clear).select("original", F.col("b.rk").alias(register_key), F.col("b.cost").alias("cost"))


def _keys() -> Column:
    """The blocks a name may stand in: its suffixes, these with an initial, and with the first two letters of a token."""
    refined = lambda by: F.flatten(F.transform("suffixes", lambda s: F.transform(by, lambda i: F.concat(s, F.lit("|"), i))))
    return F.array_distinct(F.concat("suffixes", refined("initials"), refined("heads")))


def index(acts: DataFrame, common: int = COMMON, common_refined: int = COMMON_REFINED) -> DataFrame:
    """(block, rk, act): every entry under its suffixes; one that more than ``common`` entries share is refined by their initials, and what
    more than ``common_refined`` then still share by the first two letters of their tokens. Nothing is dropped."""
    ends = acts.select("rk", "act", "initials", "heads", F.explode("suffixes").alias("suffix"))
    ends = ends.join(ends.groupBy("suffix").agg(F.count("*").alias("shared")), "suffix")
    plain = ends.where(F.col("shared") <= common).select(F.col("suffix").alias("block"), "rk", "act")
    finer = ends.where(F.col("shared") > common).select("rk", "act", "heads", "suffix", F.explode("initials").alias("i")).withColumn("block", F.concat("suffix", F.lit("|"), "i"))
    finer = finer.join(finer.groupBy("block").agg(F.count("*").alias("together")), "block")
    finest = finer.where(F.col("together") > common_refined).select("rk", "act", "suffix", F.explode("heads").alias("i"))
    finest = finest.select(F.concat("suffix", F.lit("|"), "i").alias("block"), "rk", "act").distinct()
    return cut(plain.unionByName(finer.where(F.col("together") <= common_refined).select("block", "rk", "act")).unionByName(finest))
