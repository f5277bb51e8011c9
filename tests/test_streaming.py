from __future__ import annotations

import random

from pyspark.sql import functions as F

from measura.streaming import stateful as S


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_density_agrees_with_its_twin(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    _run(S.density(S.read_stream(spark, str(tmp_path / "in"), rows.schema, 1), "k", "ts"), "dens", "complete")
    assert {tuple(r) for r in spark.table("dens").collect()} == {tuple(r) for r in S.density(rows, "k", "ts").collect()}


def test_sessions_agree_with_their_twin(spark, tmp_path):
    rng = random.Random(2)
    t, data = 0.0, []
    for _ in range(200):
        t += rng.choice([0.05, 0.2, 1.0])
        data.append((1, t, round(rng.random() * 0.3, 3)))
    rows = spark.createDataFrame(data, "k long, t double, seconds double").select("k", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "seconds")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(S.sessions(S.read_stream(spark, str(tmp_path / "in"), rows.schema), "k", "ts", "seconds"), "sess", "complete")
    assert {tuple(r) for r in spark.table("sess").collect()} == {tuple(r) for r in S.sessions(rows, "k", "ts", "seconds").collect()}


def test_latch_agrees_with_its_twin(spark, tmp_path):
    rng = random.Random(7)
    ticks = [(round(i * 0.1, 2), rng.choice(["C", "C", "G", None]), rng.random() < 0.05) for i in range(300)]
    spark.createDataFrame([(k, t, a, s) for k in (1, 2) for t, a, s in ticks], "k long, t double, label string, silent boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(S.latch(S.read_stream(spark, str(tmp_path / "in"), "k long, t double, label string, silent boolean"), "k"), "latched")
    want = S.latch_rows(ticks)
    for k in (1, 2):
        assert sorted((r.label, r.shown_at) for r in spark.table("latched").where(F.col("k") == k).collect()) == sorted(want)
