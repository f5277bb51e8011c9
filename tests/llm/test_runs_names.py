from __future__ import annotations

import random

from measura.llm.names import assigned, explain, index, link_names, subsequence_ratio, suffixes
from measura.llm.runs import collapse_runs, roots, same_line, within


def edits(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance_against_the_full_table():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        for most in (0, 1, 2):
            assert within(a, b, most) == (edits(a, b) <= most)


def test_same_line():
    base = "Run with the paper kite, run with the salt road"
    for other in (base.upper(), "run with the paper kite run with the salt road!", "Oh, " + base, base + ", yeah", "Run with the papre kite, run with the salt road", "Run  with thе paper kite, run with the saaaalt road", "Run with th e paper kite, run with the salt road"):
        assert same_line(base, other)
    assert not same_line(base, "Run with the slow train, run with the salt road")
    assert same_line("And we run", "Oh, and we run") and not same_line("salt and sand", "salt sand") and not same_line("Yes we run far", "We run far")
    assert not same_line("[music]", "Oh oh") and same_line("(Music)", "[music]")


def test_pointers_reach_the_start_of_their_chain(spark):
    rng = random.Random(3)
    links, want, at = [], {}, 0
    for n in (1, 2, 3, 17, 100):
        start = at
        for i in range(at + 1, at + n):
            links.append((i, i - 1))
            want[i] = start
        at += n + 1
    rng.shuffle(links)
    got = roots(spark.createDataFrame(links, "at long, to long"), "at", "to").collect()
    assert {r.at: r.to for r in got} == want


def test_runs_across_partitions(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for e in [1] * 300 + [2] * 50:
        k += 1
        rows.append((e, k, rng.choice([float(k), float(k // 2), None, float("nan")]) if rng.random() < 0.9 else None, rng.choice(["we run tonight", "We run tonight!", "a slow train home", None, "  "])))
    rows += rng.choices(rows, k=40)
    df = spark.createDataFrame(rows, "e long, k long, s double, t string").withColumnRenamed("s", "s0x")
    want, last = [], None
    for e, s, key, t in sorted({(e, s, k, t) for e, k, s, t in rows if s is not None and s == s and t and t.strip()}):
        if last and last[0] == e and same_line(last[3], t):
            last[2], last[3], last[4] = key, t, last[4] + 1
        else:
            last = [e, key, key, t, 1]
            want.append(last)
    got = collapse_runs(df.selectExpr("*", "1 AS at"), "e", "s0x", "k", "t").collect()
    assert sorted((r.e, r.first_key, r.last_key, r.n) for r in got) == sorted((e, a, b, n) for e, a, b, _, n in want if n > 1)
    assert collapse_runs(df.limit(0), "e", "s0x", "k", "t").count() == 0


def test_subsequence_ratio():
    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert abs(subsequence_ratio(a, b) - 2 * lcs(a, b) / (len(a) + len(b))) < 1e-12


def test_spellings_are_explained():
    act = "katherine lövseñola"
    for s in ("kathy lövseñola", "lövseñola, katherine", "k. lövseñola", "katherine lovsenola", "katherine loevsenyola", "katherine d. lövseñola", "katherinelövseñola", "katherine lövseñla", "kate lövvseñola"):
        assert explain(s, act).cost > 0 and explain(s, act).short is None, s
    assert explain(act, act).cost == 0
    for s in ("katherine", "lövseñola", "charles blazgaard", "k. l."):
        assert explain(s, act) is None, s
    assert explain("charles lövseñola", act).short == ("charles", "katherine")  # one token to be learned, or not
    assert explain("the northern zeppelins & tomás", "tomás & the northern zeppelins").short is None
    assert explain("saltyglacier qt.", "salty glacier quartet").short is None and explain("golden saddle coll.", "golden anchor collective").short == ("saddle", "anchor")
    long = "one two three four five six seven eight nine ten"
    assert explain(" ".join(long.split()[::-1]), long).short is None  # any order of any number of tokens
    assert set(suffixes(["kites"])) >= {"kites", "ites"}


def test_names_meet_their_entry(spark):
    register = spark.createDataFrame([(1, "Katherine Lövseñola"), (2, "Robert Ostrgaard"), (3, "Rebecca Ostrgaard"), (4, "The Sugar Tramways"), (5, None), (1, "Katherine Lövseñola")], "aid long, act string")
    names = ["Kathy Lövseñola", "R. Ostrgaard", "Rob Ostrgaard", "Sugar Tramways, The", "Nobody Else", None, "", " katherine  LÖVSEÑOLA ", "Kathy Lövseñola"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "artist string, original long")
    got = {r.original: (r.aid, r.cost > 0) for r in link_names(df, "artist", register, "aid", "act").collect()}
    assert got == {"Kathy Lövseñola": (1, True), "Rob Ostrgaard": (2, True), "Sugar Tramways, The": (4, True), " katherine  LÖVSEÑOLA ": (1, False)}  # an initial that fits two means none
    assert link_names(df.limit(0), "artist", register, "aid", "act").count() == 0
    assert link_names(df, "artist", register.limit(0), "aid", "act").count() == 0


def test_assignment_is_the_cheapest():
    from itertools import permutations

    rng = random.Random(2)
    for _ in range(200):
        n, m = sorted(rng.randint(1, 5) for _ in range(2))
        costs = [[rng.choice([0.0, 0.1, 0.5, 1.0, 2.2, 100.0]) for _ in range(m)] for _ in range(n)]
        got = assigned(costs)
        assert len(set(got)) == n
        assert abs(sum(costs[i][j] for i, j in enumerate(got)) - min(sum(costs[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def test_short_forms_are_learned_from_the_names(spark):
    surnames = ["Ulmmann", "Taviaker", "Orlandri", "Blazmann"]
    register = spark.createDataFrame([(i, f"Anselm {s}") for i, s in enumerate(surnames)] + [(9, "Oda Quellbach"), (10, "Anselm Quellbach")], "aid long, act string")
    names = [f"Selmo {s}" for s in surnames[:3]] + ["Blazmann, Selmo", "Charles Orlandri", "Selmo Orlndri", "Oda Quellbach", "Selmo Quellbach"]
    df = spark.createDataFrame([(n,) for n in names], "artist string")
    got = {r.original: r.aid for r in link_names(df, "artist", register, "aid", "act").collect()}
    assert got == {"Selmo Ulmmann": 0, "Selmo Taviaker": 1, "Selmo Orlandri": 2, "Blazmann, Selmo": 3, "Selmo Orlndri": 2, "Oda Quellbach": 9, "Selmo Quellbach": 10}
    few = df.where("artist = 'Selmo Ulmmann'")
    assert link_names(few, "artist", register, "aid", "act").count() == 0  # one entry is no evidence
    known = spark.createDataFrame([("selmo", "anselm")], "short string, full string")
    assert [r.aid for r in link_names(few, "artist", register, "aid", "act", known).collect()] == [0]


def test_common_suffixes_are_refined_and_none_is_dropped(spark):
    acts = spark.createDataFrame([(i, f"act {i}", ["mann"], [chr(97 + i % 3)], [f"{chr(97 + i % 3)}{chr(97 + i % 7)}"]) for i in range(40)], "rk long, act string, suffixes array<string>, initials array<string>, heads array<string>")
    blocks = index(acts, common=5, common_refined=13)
    assert {r.rk for r in blocks.collect()} == set(range(40))
    kinds = {r.block for r in blocks.collect()}
    assert "mann" not in kinds and "mann|b" in kinds and "mann|a" not in kinds and "mann|aa" in kinds
