from __future__ import annotations

import random

from measura.operators.intervals import periods_and_gaps


def brute(rows):
    out = set()
    seen = {}
    for e, k, s, t in rows:
        if s is not None and t is not None and k is not None and t >= s:
            seen.setdefault(e, set()).add((s, t, k))
    for e, items in seen.items():
        stretches = []
        for s, t, _ in sorted(items):
            if stretches and s <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], t)
                stretches[-1][2] += 1
            else:
                stretches.append([s, t, 1])
        out |= {(e, "period", s, t, n) for s, t, n in stretches if n > 1}
        out |= {(e, "gap", a[1], b[0], 0) for a, b in zip(stretches, stretches[1:], strict=False)}
    return out


def run(spark, rows, partitions):
    df = spark.createDataFrame(rows, "entity string, k long, a long, b long")
    got = periods_and_gaps(df.selectExpr("entity", "k", "a", "b", "1 AS what"), ["entity"], "a", "b", "k", partitions).collect()
    out = [tuple(r) for r in got]
    assert len(out) == len(set(out))
    return set(out)


def test_random_intervals_over_many_partitions(spark):
    rng = random.Random(5)
    for partitions in (1, 3, 13):
        rows = []
        for i in range(400):
            e = rng.choice(["hot", "hot", "hot", "a", "b", None])
            s = rng.randrange(0, 3000)
            rows.append((e, i, s, s + rng.randrange(0, 12)))
        rows += rng.choices(rows, k=60)  # repeated rows count once
        assert run(spark, rows, partitions) == brute(rows)


def test_one_interval_covers_all_partitions(spark):
    rows = [("x", 0, 0, 10_000)] + [("x", i, i * 20, i * 20 + 5) for i in range(1, 300)] + [("x", 999, 10_000, 10_001), ("x", 1000, 10_003, 10_004)]
    assert run(spark, rows, 7) == {("x", "period", 0, 10_001, 301), ("x", "gap", 10_001, 10_003, 0)}


def test_nulls_backward_and_empty(spark):
    rows = [("x", 1, None, 5), ("x", 2, 5, None), ("x", 3, 9, 2), ("x", None, 1, 2), ("x", 4, 1, 2)]
    assert run(spark, rows, 2) == set()
    assert run(spark, [], 2) == set()


def _probe(spark, seed, partitions):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), i, s, s + rng.randrange(0, 9)) for i, s in enumerate(rng.choices(range(40_000), k=9_000))]
    df = spark.createDataFrame(rows, "entity string, k long, a long, b long")
    return periods_and_gaps(df, ["entity"], "a", "b", "k", partitions), brute(rows)


def test_results_may_be_coalesced_unioned_and_joined(spark):
    one, want = _probe(spark, 1, 6)
    two, want_two = _probe(spark, 2, 5)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(one.coalesce(1)) == sorted(want)
    assert rows(one.coalesce(4)) == sorted(want)
    assert rows(one.union(two)) == sorted([*want, *want_two])
    assert rows(two.union(one).coalesce(2)) == sorted([*want, *want_two])
    names = spark.createDataFrame([("hot", 1), ("a", 2)], "entity string, x int")
    assert rows(one.join(names, "entity").drop("x")) == sorted(r for r in want if r[0] in ("hot", "a"))
    blocks = [i.id() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()]
    for b in blocks:  # lost blocks are computed again with the same numbers
        spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().removeRdd(b)
    assert rows(one.union(two)) == sorted([*want, *want_two])


def test_summaries_hold_for_a_scan_read_in_fewer_tasks(spark):
    from measura.operators.rangescan import numbered

    df = spark.range(0, 5000, 1, 7).selectExpr("id", "hash(id) AS h")
    want = {r[1]: n for n, r in enumerate(sorted((r.h, r.id) for r in df.collect()), 1)}
    got = numbered(df, ["h", "id"], "id", "place")
    assert {r.id: r.place for r in got.coalesce(1).collect()} == want


def test_prefix_maximum_over_partitions(spark):
    from measura.operators.intervals import prefix_max

    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, *range(500)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, id long, v long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    got = {r.id: r.reach for r in prefix_max(df, ["kind"], ["id"], "v", "reach").coalesce(2).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, top = {}, {}
    for kind, i, v in rows:
        if v is not None:
            want[i] = top[kind] = max(v, top.get(kind, v))
    assert got == want
    assert prefix_max(df.limit(0), ["kind"], ["id"], "v", "reach").count() == 0


def test_loops_after_edits(spark):
    from measura.operators.sequences import edit_loops

    rows = [(1, "click", 4.0), (1, "view", 6.0), (2, "view", 0.1), (3, "click", 4.0), (3, "view", 4.2), (4, "click", 1.0), (4, "signup", 9.0), (5, "view", 3.0), (5, "click", 5.0)]
    df = spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1)
    got = {r.user_id: tuple(r)[1:] for r in df.mapInArrow(edit_loops(0.25, 1.0), "user_id long, loop_start double, loop_end double, active boolean, refused long").collect()}
    assert got == {1: (4.0, 6.0, True, 0), 2: (0.0, 0.1, False, 1), 3: (4.0, 4.2, False, 1), 4: (0.0, 0.0, False, 0), 5: (5.0, 6.0, True, 0)}
