"""Queries over cues and words in order."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.operators import sequences as S
from measura.plans.notes import CHORDS_SQL, chords, grouped
from measura.session import table
from measura.sources.bind import CUES_SQL, WORDS_SQL, finite, load_cues, load_words

_CUE_ORDER = ("start", "end", "cue_id")


def e1_has_word_gap(spark, d):
    """Cues whose words leave a gap of more than a second."""
    w = S.total_order("cue_id", "start", "end", "word_id")
    gap = F.col("start") - F.lag("end").over(w) > S.WORD_GAP
    return load_words(spark, d).withColumn("gap", gap).groupBy("cue_id").agg(F.coalesce(F.bool_or("gap"), F.lit(False)).alias("has_gap"))


def e2_split_word_gaps(spark, d):
    """The parts of each cue between such gaps."""
    p = S.split_gaps(load_words(spark, d), "cue_id")
    return p.groupBy("cue_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("words"))


def e5_trim_holds(spark, d):
    return load_cues(spark, d).select("cue_id", F.round(S.trim_hold(F.col("start"), F.col("end"), F.col("text")), 6).alias("end"))


def e6_cap_runs(spark, d):
    """Cues without the tail of runs of more than twelve equal lower-case lines."""
    c = load_cues(spark, d).withColumn("fold", F.lower(F.trim("text")))
    return S.cap_runs(c, "attempt_id", _CUE_ORDER, "fold").select("cue_id", "attempt_id")


def e7_min_display(spark, d):
    return S.min_display(load_cues(spark, d), "attempt_id", _CUE_ORDER).select("cue_id", F.round("end", 6).alias("end"))


def e9_monotone_words(spark, d):
    """Word starts clamped so that none goes back in its cue."""
    w = W.partitionBy("cue_id").orderBy("word_ix", "word_id").rowsBetween(W.unboundedPreceding, 0)
    cursor = F.max("start").over(w)
    return load_words(spark, d).select("word_id", cursor.alias("start"), F.greatest(F.col("end"), cursor).alias("end"))


def e10_spread_words(spark, d):
    return S.spread_words(load_cues(spark, d), "cue_id")


def e11_anchor_interpolation(spark, d):
    """Starts of unsure words (two of every four) laid out between the sure words around them, each by the letters it has.

    A stretch shares the time from the end of the sure word before it to the start of the next by ``max(0.04, 0.09 a letter)``;
    one without a next word runs on at that rate. No word starts before the one in front of it.
    """
    w = W.partitionBy("cue_id").orderBy("start", "word_id")
    n = load_words(spark, d).withColumn("n", F.row_number().over(w))
    sure = ~(F.col("n") % 4).isin(2, 3)
    n = n.withColumns({"sure": sure, "size": F.when(sure, 0.0).otherwise(F.greatest(F.lit(0.04), S.weight(F.col("text")) * 0.09))})
    n = n.withColumn("stretch", F.count_if("sure").over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy("cue_id", "stretch")
    n = n.withColumns({
        "left": F.max(F.when(F.col("sure"), F.col("end"))).over(own), "right": F.first(F.when(F.col("sure"), F.col("start")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)),
        "total": F.sum("size").over(own), "done": F.sum("size").over(own.orderBy("start", "word_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"),
    })
    share = F.when(F.col("right").isNull(), F.col("done")).otherwise(F.greatest(F.lit(0.0), F.col("right") - F.col("left")) * F.col("done") / F.col("total"))
    placed = n.withColumn("at", F.when(F.col("sure"), F.col("start")).otherwise(F.col("left") + share))
    return placed.select("word_id", F.round(F.max("at").over(w.rowsBetween(W.unboundedPreceding, 0)), 6).alias("start"))


def e12_displacement(spark, d):
    """How far each word start lies outside its cue."""
    c = load_cues(spark, d).select("cue_id", F.col("start").alias("low"), F.col("end").alias("high"))
    return load_words(spark, d).join(c, "cue_id").select("word_id", F.round(F.greatest(F.col("start") - F.col("high"), F.col("low") - F.col("start"), F.lit(0.0)), 6).alias("displacement"))


def e13_least_span(spark, d):
    """Cue ends at least 0.05 s after the start unless the next line comes first."""
    nxt = F.lead("start").over(S.total_order("attempt_id", *_CUE_ORDER))
    want = F.greatest(F.col("end"), F.col("start") + F.lit(0.05))
    return load_cues(spark, d).select("cue_id", F.least(want, F.greatest(F.coalesce(nxt, want), F.col("start"))).alias("end"))


def e15_latest_onset(spark, d):
    """Of the onset groups' notes of one pitch class at a time, the latest to start."""
    g = grouped(spark, d)
    w = W.partitionBy("run_id", F.floor("start"), F.col("pitch") % 12).orderBy(F.desc("start"), F.desc("pitch"), F.desc("end"))
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("run_id", F.floor("start").alias("second"), (F.col("pitch") % 12).alias("pc"), "pitch", "start")


def e17_gap_tiles(spark, d):
    return S.gap_tiles(load_cues(spark, d), "attempt_id", _CUE_ORDER)


def e18_cue_words(spark, d):
    """Words of each cue: its timed words where it has any, else its text spread over its time."""
    words = load_words(spark, d).select("cue_id", F.col("word_ix").cast("int").alias("word_ix"), F.col("start").alias("word_start"), F.col("end").alias("word_end"))
    bare = load_cues(spark, d).join(words.select("cue_id"), "cue_id", "left_anti")
    return words.unionByName(S.spread_words(bare, "cue_id").drop("word"))


def s8_chord_latch(spark, d):
    """When each chord label has stood for a quarter of a second and is shown."""
    ticks = grouped(spark, d).select("run_id", "anchor").distinct().join(chords(spark, d), ["run_id", "anchor"], "left")
    w = W.partitionBy("run_id").orderBy("anchor")
    ticks = ticks.withColumn("quiet", F.coalesce(F.col("anchor") - F.lag("anchor").over(w) > 2.0, F.lit(False)))
    # silence stands before the tick that follows it
    return S.latched(ticks.withColumn("__q", F.col("quiet")), "run_id", "anchor", "chord", F.col("__q") & F.col("chord").isNull())


def d13_longest_run(spark, d):
    """Longest run of consecutive cues without a timed word, by attempt."""
    timed = load_words(spark, d).select("cue_id").distinct().withColumn("timed", F.lit(True))
    c = load_cues(spark, d).join(timed, "cue_id", "left").withColumn("bare", F.col("timed").isNull())
    runs = S.islands(c, "attempt_id", _CUE_ORDER, "bare").where("bare").groupBy("attempt_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("attempt_id").agg(F.max("n").alias("longest"))


def d9_weighted_score(spark, d):
    """Log probability of an attempt, weighted by time; -10 where nothing is covered."""
    c = load_cues(spark, d).where(F.col("avg_logprob").isNotNull() & ~F.isnan("avg_logprob") & (F.col("avg_logprob") > float("-inf")))
    span = F.col("end") - F.col("start")
    return c.groupBy("attempt_id").agg(F.round(F.sum(span), 6).alias("covered"), F.round(F.when(F.sum(span) > 0, F.sum(F.col("avg_logprob") * span) / F.sum(span)).otherwise(-10.0), 6).alias("score"))


def d10_choose_attempt(spark, d):
    """Of the attempts of a song, the one to keep and why: empty, coverage, score, tie or single.

    In the order of their ids each attempt is held against the one kept so far; the reason is that of the last decision.
    """
    a = table(spark, d, "attempts").select("attempt_id", "song_id").distinct().join(d9_weighted_score(spark, d), "attempt_id", "left")
    rows = a.select("song_id", "attempt_id", "covered", "score").repartition("song_id").sortWithinPartitions("song_id", "attempt_id")
    return rows.mapInArrow(S.choose_attempts, "song_id long, attempt_id long, reason string")


def d14_word_span(spark, d):
    return load_words(spark, d).groupBy("cue_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_and(F.col("end") > F.col("start")).alias("all_timed"))


def d15_used_fraction(spark, d):
    """Share of the cues of an attempt that hold a timed word."""
    used = load_words(spark, d).select("cue_id").distinct().withColumn("used", F.lit(1))
    return load_cues(spark, d).join(used, "cue_id", "left").groupBy("attempt_id").agg(F.round(F.count("used") / F.count("*"), 4).alias("fraction"))


def d19_rate(spark, d):
    """Seconds a letter of an attempt from its first and last cue, within 0.02 and 0.5; 0.09 below two cues."""
    c = load_cues(spark, d).groupBy("attempt_id").agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("b"), F.sum(S.weight(F.col("text"))).alias("chars"))
    return c.select("attempt_id", F.when(F.col("n") < 2, 0.09).otherwise(F.round(F.greatest(F.lit(0.02), F.least(F.lit(0.5), (F.col("b") - F.col("a")) / F.col("chars"))), 6)).alias("rate"))


def d20_readiness(spark, d):
    """Whether all, and whether any, of the attempts of a song have a confidence in range."""
    a = table(spark, d, "attempts").select("attempt_id", "song_id", "language_confidence").distinct()
    ok = F.coalesce(F.col("language_confidence").between(0.0, 1.0) & ~F.isnan("language_confidence"), F.lit(False))
    return a.groupBy("song_id").agg(F.bool_and(ok).alias("all_ready"), F.bool_or(ok).alias("any_ready"))


def a32_order_violations(spark, d):
    """Cues that start before the cue listed before them, by attempt (in the order of their ids)."""
    w = W.partitionBy("attempt_id").orderBy("cue_id")
    return load_cues(spark, d).withColumn("back", F.lag("start").over(w) > F.col("start")).groupBy("attempt_id").agg(F.count_if("back").alias("violations"))


def b4_clean_cues(spark, d):
    """Cues clipped to the duration of their song, where it is known: starts from 0, ends at least 0.05 s later, none from the duration on."""
    songs = table(spark, d, "attempts").groupBy("attempt_id").agg(F.min("song_id").alias("song_id"))
    known = table(spark, d, "media_metadata").where(finite("duration") & (F.col("duration") > 0)).groupBy("song_id").agg(F.max("duration").alias("duration"))
    c = load_cues(spark, d).join(songs.join(known, "song_id"), "attempt_id", "left").select("cue_id", F.greatest(F.col("start"), F.lit(0.0)).alias("start"), "end", "duration")
    inside = c.where("duration IS NULL OR start < duration")
    return inside.select("cue_id", "start", F.least(F.greatest("end", F.col("start") + F.lit(0.05)), "duration").alias("end"))


def b7_runaway_repetition(spark, d):
    """Longest back-to-back repetition of a single word in each cue."""
    w = load_cues(spark, d).select("cue_id", F.posexplode(F.split(F.lower(F.trim("text")), r"\s+")).alias("ix", "tok"))
    runs = S.islands(w, "cue_id", ("ix",), "tok").groupBy("cue_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("cue_id").agg(F.max("n").alias("repeats"))


def s9_wraps(spark, d):
    """Times that the play position of a user (value of their events) falls back by more than 0.25, and the speed after them."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("wrap", F.coalesce(F.lag("value").over(w) - F.col("value") > 0.25, F.lit(False)))
    return e.groupBy("user_id").agg(F.count_if("wrap").alias("wraps")).select("user_id", "wraps", F.round(F.least(F.lit(1.0), 0.5 + F.col("wraps") * 0.05), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (e1_has_word_gap, e2_split_word_gaps, e5_trim_holds, e6_cap_runs, e7_min_display, e9_monotone_words, e10_spread_words, e11_anchor_interpolation, e12_displacement, e13_least_span, e15_latest_onset, e17_gap_tiles, e18_cue_words, s8_chord_latch, d13_longest_run, d9_weighted_score, d10_choose_attempt, d14_word_span, d15_used_fraction, d19_rate, d20_readiness, a32_order_violations, b4_clean_cues, b7_runaway_repetition, s9_wraps)}

_CO = 'PARTITION BY attempt_id ORDER BY start, "end", cue_id'
_SPLIT = r"string_split_regex(trim(text), '\s+')"
_WEIGHT = lambda c: rf"greatest(length(regexp_replace({c}, '[^\p{{L}}\p{{N}}]', '', 'g')), 1)"
_SPREAD = f"""sw AS (SELECT cue_id, start, "end", unnest({_SPLIT}) AS word, generate_subscripts({_SPLIT}, 1) - 1 AS word_ix FROM src),
sx AS (SELECT *, {_WEIGHT("word")} AS w FROM sw WHERE word <> ''),
spread AS (SELECT cue_id, word_ix::INT AS word_ix, word, round(start + ("end" - start) * (sum(w) OVER o - w) / sum(w) OVER (PARTITION BY cue_id), 9) AS word_start, round(start + ("end" - start) * (sum(w) OVER o) / sum(w) OVER (PARTITION BY cue_id), 9) AS word_end FROM sx WINDOW o AS (PARTITION BY cue_id ORDER BY word_ix ROWS UNBOUNDED PRECEDING))"""
_SUNG = f"(0.35::DOUBLE + len({_SPLIT}) * 0.55::DOUBLE)"
_SCORE = f"""{CUES_SQL}, sc AS (SELECT attempt_id, round(sum("end" - start), 6) AS covered, round(CASE WHEN sum("end" - start) > 0 THEN sum(avg_logprob * ("end" - start)) / sum("end" - start) ELSE -10 END, 6) AS score FROM cues_c WHERE isfinite(avg_logprob) GROUP BY 1)"""
ORACLES = {
    "e1_has_word_gap": f'WITH {WORDS_SQL}, g AS (SELECT cue_id, start - lag("end") OVER (PARTITION BY cue_id ORDER BY start, "end", word_id) > 1.0 AS gap FROM words_c) SELECT cue_id, coalesce(bool_or(gap), false) AS has_gap FROM g GROUP BY 1',
    "e2_split_word_gaps": f"""WITH {WORDS_SQL}, g AS (SELECT *, coalesce((start - lag("end") OVER (PARTITION BY cue_id ORDER BY start, "end", word_id) > 1.0)::INT, 0) AS cut FROM words_c), p AS (SELECT *, sum(cut) OVER (PARTITION BY cue_id ORDER BY start, "end", word_id ROWS UNBOUNDED PRECEDING)::INT AS part FROM g) SELECT cue_id, part, min(start) AS start, max("end") AS "end", count(*) AS words FROM p GROUP BY 1, 2""",
    "e5_trim_holds": f"""WITH {CUES_SQL} SELECT cue_id, round(CASE WHEN "end" - start > 6 AND "end" - start > {_SUNG} * 3 THEN least("end", greatest(start + 1.2::DOUBLE, start + {_SUNG} + 1.0)) ELSE "end" END, 6) AS "end" FROM cues_c""",
    "e6_cap_runs": f"""WITH {CUES_SQL}, f AS (SELECT *, lower(trim(text)) AS fold FROM cues_c), l AS (SELECT *, coalesce((lag(fold) OVER ({_CO}) <> fold)::INT, 0) AS cut FROM f), i AS (SELECT *, sum(cut) OVER ({_CO} ROWS UNBOUNDED PRECEDING) AS isl FROM l) SELECT cue_id, attempt_id FROM i QUALIFY row_number() OVER (PARTITION BY attempt_id, isl ORDER BY start, "end", cue_id) <= 12""",
    "e7_min_display": f"""WITH {CUES_SQL}, n AS (SELECT *, lead(start) OVER ({_CO}) AS nxt FROM cues_c) SELECT cue_id, round(greatest(start, least(greatest("end", start + 1.2::DOUBLE), coalesce(nxt, greatest("end", start + 1.2::DOUBLE)))), 6) AS "end" FROM n""",
    "e9_monotone_words": f"""WITH {WORDS_SQL}, c AS (SELECT word_id, "end", max(start) OVER (PARTITION BY cue_id ORDER BY word_ix, word_id ROWS UNBOUNDED PRECEDING) AS s FROM words_c) SELECT word_id, s AS start, greatest("end", s) AS "end" FROM c""",
    "e10_spread_words": f"WITH {CUES_SQL}, src AS (SELECT * FROM cues_c), {_SPREAD} SELECT * FROM spread",
    "e11_anchor_interpolation": f"""WITH {WORDS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY start, word_id) AS n FROM words_c), m AS (SELECT *, n % 4 NOT IN (2, 3) AS sure, CASE WHEN n % 4 IN (2, 3) THEN greatest(0.04::DOUBLE, {_WEIGHT("text")} * 0.09::DOUBLE) ELSE 0 END AS size FROM n),
i AS (SELECT *, count(*) FILTER (sure) OVER (PARTITION BY cue_id ORDER BY start, word_id ROWS UNBOUNDED PRECEDING) AS stretch FROM m),
x AS (SELECT *, max("end") FILTER (sure) OVER (PARTITION BY cue_id, stretch) AS l, first_value(CASE WHEN sure THEN start END IGNORE NULLS) OVER (PARTITION BY cue_id ORDER BY start, word_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r, sum(size) OVER (PARTITION BY cue_id, stretch) AS total, sum(size) OVER (PARTITION BY cue_id, stretch ORDER BY start, word_id ROWS UNBOUNDED PRECEDING) - size AS done FROM i),
p AS (SELECT *, CASE WHEN sure THEN start WHEN r IS NULL THEN l + done ELSE l + greatest(0, r - l) * done / total END AS at_ FROM x)
SELECT word_id, round(max(at_) OVER (PARTITION BY cue_id ORDER BY start, word_id ROWS UNBOUNDED PRECEDING), 6) AS start FROM p""",
    "e12_displacement": f"""WITH {CUES_SQL}, {WORDS_SQL} SELECT w.word_id, round(greatest(w.start - c."end", c.start - w.start, 0), 6) AS displacement FROM words_c w JOIN cues_c c USING (cue_id)""",
    "e13_least_span": f"""WITH {CUES_SQL}, n AS (SELECT *, lead(start) OVER ({_CO}) AS nxt, greatest("end", start + 0.05::DOUBLE) AS want FROM cues_c) SELECT cue_id, least(want, greatest(coalesce(nxt, want), start)) AS "end" FROM n""",
    "e15_latest_onset": f"""WITH RECURSIVE {CHORDS_SQL} SELECT run_id, CAST(floor(start) AS BIGINT) AS second, pitch % 12 AS pc, pitch, start FROM groups_c QUALIFY row_number() OVER (PARTITION BY run_id, floor(start), pitch % 12 ORDER BY start DESC, pitch DESC, "end" DESC) = 1""",
    "e17_gap_tiles": f"""WITH {CUES_SQL}, n AS (SELECT *, lead(start) OVER ({_CO}) AS nxt FROM cues_c), t AS (SELECT attempt_id, "end", nxt, unnest(generate_series(0, CAST(ceil((nxt - "end") / 6.0::DOUBLE) AS BIGINT) - 1)) AS k FROM n WHERE nxt - "end" > 1.2::DOUBLE) SELECT attempt_id, "end" + k * 6.0::DOUBLE AS tile_start, least(nxt, "end" + (k + 1) * 6.0::DOUBLE) AS tile_end FROM t""",
    "e18_cue_words": f"""WITH {CUES_SQL}, {WORDS_SQL}, src AS (SELECT * FROM cues_c WHERE cue_id NOT IN (SELECT cue_id FROM words_c WHERE cue_id IS NOT NULL)), {_SPREAD} SELECT cue_id, word_ix::INT AS word_ix, start AS word_start, "end" AS word_end FROM words_c UNION ALL SELECT cue_id, word_ix, word_start, word_end FROM spread""",
    "s8_chord_latch": f"""WITH RECURSIVE {CHORDS_SQL}, tk AS (SELECT g.run_id, g.anchor, c.chord FROM (SELECT DISTINCT run_id, anchor FROM groups_c) g LEFT JOIN chords c ON c.run_id = g.run_id AND c.anchor = g.anchor),
q AS (SELECT *, coalesce(anchor - lag(anchor) OVER (PARTITION BY run_id ORDER BY anchor) > 2.0, false) AND chord IS NULL AS quiet FROM tk),
z AS (SELECT *, sum(quiet::INT) OVER (PARTITION BY run_id ORDER BY anchor ROWS UNBOUNDED PRECEDING) AS zone FROM q),
nm AS (SELECT *, coalesce((lag(chord) OVER (PARTITION BY run_id, zone ORDER BY anchor) <> chord)::INT, 0) AS cut FROM z WHERE chord IS NOT NULL),
il AS (SELECT *, sum(cut) OVER (PARTITION BY run_id, zone ORDER BY anchor ROWS UNBOUNDED PRECEDING) AS isl FROM nm),
sn AS (SELECT *, min(anchor) OVER (PARTITION BY run_id, zone, isl) AS since FROM il)
SELECT run_id, chord, min(anchor) AS shown_at FROM sn WHERE anchor - since >= 0.25 GROUP BY run_id, zone, isl, chord""",
    "d13_longest_run": f"""WITH {CUES_SQL}, {WORDS_SQL}, b AS (SELECT c.*, c.cue_id NOT IN (SELECT cue_id FROM words_c WHERE cue_id IS NOT NULL) AS bare FROM cues_c c), l AS (SELECT *, coalesce((lag(bare) OVER ({_CO}) <> bare)::INT, 0) AS cut FROM b), i AS (SELECT *, sum(cut) OVER ({_CO} ROWS UNBOUNDED PRECEDING) AS isl FROM l), r AS (SELECT attempt_id, isl, count(*) AS n FROM i WHERE bare GROUP BY 1, 2) SELECT attempt_id, max(n) AS longest FROM r GROUP BY 1""",
    "d9_weighted_score": f"WITH {_SCORE} SELECT * FROM sc",
    "d10_choose_attempt": f"""WITH RECURSIVE {_SCORE}, a AS (SELECT x.attempt_id, x.song_id, sc.covered AS c, sc.score AS s, row_number() OVER (PARTITION BY x.song_id ORDER BY x.attempt_id) AS n FROM (SELECT DISTINCT attempt_id, song_id FROM attempts) x LEFT JOIN sc USING (attempt_id)),
f AS (SELECT song_id, n, attempt_id, c, s, 'single' AS reason FROM a WHERE n = 1 UNION ALL
 SELECT song_id, n, CASE WHEN take THEN other ELSE attempt_id END, CASE WHEN take THEN oc ELSE c END, CASE WHEN take THEN os ELSE s END, why FROM (
  SELECT f.song_id, a.n, f.attempt_id, f.c, f.s, a.attempt_id AS other, a.c AS oc, a.s AS os,
   CASE WHEN a.c IS NULL OR f.c IS NULL THEN 'empty' WHEN a.c < f.c * 0.6::DOUBLE OR f.c < a.c * 0.6::DOUBLE THEN 'coverage' WHEN a.s > f.s + 0.05::DOUBLE OR f.s > a.s + 0.05::DOUBLE THEN 'score' ELSE 'tie' END AS why,
   CASE WHEN a.c IS NULL OR f.c IS NULL THEN a.c IS NOT NULL WHEN a.c < f.c * 0.6::DOUBLE OR f.c < a.c * 0.6::DOUBLE THEN a.c >= f.c * 0.6::DOUBLE ELSE a.s > f.s + 0.05::DOUBLE END AS take
  FROM f JOIN a ON a.song_id = f.song_id AND a.n = f.n + 1))
SELECT song_id, attempt_id, reason FROM f QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY n DESC) = 1""",
    "d14_word_span": f'WITH {WORDS_SQL} SELECT cue_id, min(start) AS start, max("end") AS "end", bool_and("end" > start) AS all_timed FROM words_c GROUP BY 1',
    "d15_used_fraction": f"WITH {CUES_SQL}, {WORDS_SQL} SELECT attempt_id, round(count(*) FILTER (cue_id IN (SELECT cue_id FROM words_c)) / count(*), 4) AS fraction FROM cues_c GROUP BY 1",
    "d19_rate": f"""WITH {CUES_SQL}, c AS (SELECT attempt_id, count(*) AS n, min(start) AS a, max("end") AS b, sum({_WEIGHT("text")}) AS chars FROM cues_c GROUP BY 1) SELECT attempt_id, CASE WHEN n < 2 THEN 0.09 ELSE round(greatest(0.02::DOUBLE, least(0.5::DOUBLE, (b - a) / chars)), 6) END AS rate FROM c""",
    "d20_readiness": "WITH a AS (SELECT DISTINCT attempt_id, song_id, language_confidence FROM attempts) SELECT song_id, bool_and(coalesce(language_confidence BETWEEN 0 AND 1 AND NOT isnan(language_confidence), false)) AS all_ready, bool_or(coalesce(language_confidence BETWEEN 0 AND 1 AND NOT isnan(language_confidence), false)) AS any_ready FROM a GROUP BY 1",
    "a32_order_violations": f"WITH {CUES_SQL}, b AS (SELECT attempt_id, lag(start) OVER (PARTITION BY attempt_id ORDER BY cue_id) > start AS back FROM cues_c) SELECT attempt_id, count(*) FILTER (back) AS violations FROM b GROUP BY 1",
    "b4_clean_cues": f"""WITH {CUES_SQL}, s AS (SELECT attempt_id, min(song_id) AS song_id FROM attempts GROUP BY 1), k AS (SELECT song_id, max(duration) AS d FROM media_metadata WHERE isfinite(duration) AND duration > 0 GROUP BY 1), j AS (SELECT c.*, k.d FROM cues_c c LEFT JOIN s USING (attempt_id) LEFT JOIN k USING (song_id))
SELECT cue_id, greatest(start, 0.0::DOUBLE) AS start, least(greatest("end", start + 0.05::DOUBLE), coalesce(d, 'infinity'::DOUBLE)) AS "end" FROM j WHERE d IS NULL OR start < d""",
    "b7_runaway_repetition": rf"""WITH {CUES_SQL}, w AS (SELECT cue_id, unnest(string_split_regex(lower(trim(text)), '\s+')) AS tok, generate_subscripts(string_split_regex(lower(trim(text)), '\s+'), 1) AS ix FROM cues_c), l AS (SELECT *, coalesce((lag(tok) OVER (PARTITION BY cue_id ORDER BY ix) <> tok)::INT, 0) AS cut FROM w), i AS (SELECT *, sum(cut) OVER (PARTITION BY cue_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS isl FROM l), r AS (SELECT cue_id, isl, count(*) AS n FROM i GROUP BY 1, 2) SELECT cue_id, max(n) AS repeats FROM r GROUP BY 1""",
    "s9_wraps": "WITH e AS (SELECT user_id, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value > 0.25, false) AS wrap FROM events), g AS (SELECT user_id, count(*) FILTER (wrap) AS wraps FROM e GROUP BY 1) SELECT user_id, wraps, round(least(1.0::DOUBLE, 0.5::DOUBLE + wraps * 0.05::DOUBLE), 6) AS rate FROM g",
}
