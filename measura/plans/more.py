"""Further queries: decoder filter, word cleaning, hand medians, provenance, candidate shapes, look-ahead."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions import text as X
from measura.operators import interval_joins as J
from measura.operators import notes as N
from measura.operators import sequences as S
from measura.plans.joins import _LF, _low_frets
from measura.plans.notes import _POS, GROUPS_SQL, SELECTED_SQL, TUNING_SQL, grouped, selected
from measura.plans.text import _LY
from measura.session import table
from measura.sources import timed_text as P
from measura.sources.bind import CUES_SQL, NOTES_SQL, WORDS_SQL, load_cues, load_notes, load_words


def b5_filter_cues(spark, d):
    """Cues that a decoder filter keeps: with words, without a word said over sixteen times running, and in speech where their attempt has timed words."""
    cues = load_cues(spark, d)
    bare = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    w = cues.select("cue_id", F.posexplode(F.split(F.lower(F.trim("text")), r"\s+")).alias("ix", "tok"))
    runs = S.islands(w, "cue_id", ("ix",), "tok").groupBy("cue_id", "island").agg(F.count("*").alias("n")).groupBy("cue_id").agg(F.max("n").alias("repeats"))
    spans = load_words(spark, d).where("end > start").select("attempt_id", F.col("start").alias("ws"), F.col("end").alias("we"))
    kept = cues.where(bare != "").join(runs, "cue_id").where("repeats <= 16").select("attempt_id", "cue_id", "start", "end")
    heard = J.overlap_join(kept, spans, "attempt_id", ("start", "end"), ("ws", "we"), 4.0, "left_semi")
    silent = kept.join(spans.select("attempt_id").distinct(), "attempt_id", "left_anti")
    return heard.unionByName(silent).select("cue_id")


def b10_word_cleaning(spark, d):
    """Words with text in the order of their time, each end not before its start, and how many of an attempt were left out."""
    t = table(spark, d, "lyric_words").select("word_id", "attempt_id", "start_s", "end_s", "text").dropDuplicates(["word_id"])
    bad = F.col("start_s").isNull() | F.isnan("start_s") | (F.col("start_s") < 0) | (F.trim(F.coalesce("text", F.lit(""))) == "")
    return t.groupBy("attempt_id").agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("ignored"), F.round(F.sum(F.when(~bad, F.greatest(F.coalesce("end_s", "start_s"), "start_s") - F.col("start_s"))), 4).alias("seconds"))


def d8_hand_median(spark, d):
    """Mean-of-the-middle median of the fretted lowest-string frets of each onset group."""
    low = N.positions(selected(spark, d)).groupBy("run_id", "anchor", "pitch").agg(F.min("fret").alias("fret")).where("fret > 0")
    return low.groupBy("run_id", "anchor").agg(F.median("fret").alias("hand"))


def d7_lower_median(spark, d):
    """Lower median of the fretted frets of each run."""
    return _low_frets(spark, d).where("fret >= 1").groupBy("run_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY fret)").cast("int").alias("centre"))


def j12_position_pairs(spark, d):
    """Pairs of positions of two pitches of an onset group on different strings within five frets."""
    p = N.positions(selected(spark, d)).select("run_id", "anchor", "pitch", "string", "fret")
    a, b = p.alias("a"), p.alias("b")
    on = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.pitch") < F.col("b.pitch")) & (F.col("a.string") != F.col("b.string"))
    near = (F.col("a.fret") == 0) | (F.col("b.fret") == 0) | (F.abs(F.col("a.fret") - F.col("b.fret")) <= 5)
    return a.join(b, on & near).groupBy("a.run_id", "a.anchor").agg(F.count("*").alias("pairs"))


def a24_json_cues(spark, d):
    """Cue documents (one for each attempt, as JSON) read back whole, or rejected: those with a cue that ends before it starts."""
    c = table(spark, d, "raw_cues").where("start_s IS NOT NULL AND NOT isnan(start_s) AND text IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(end_s)").select("attempt_id", "cue_id", "start_s", "end_s", "text").dropDuplicates(["cue_id"])
    docs = c.groupBy("attempt_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", "start_s", "end_s", "text"))), lambda x: F.struct(x["start_s"].alias("start"), x["end_s"].alias("end"), x["text"].alias("text")))).alias("doc"))
    return P.json_cues(docs, "attempt_id", "doc").groupBy("attempt_id").agg(F.count("cue_ix").alias("cues"), F.max("reject").alias("reject"))


def a25_provenance(spark, d):
    """Timing of each sheet from what it is; ``a25_stored_reports`` reads the reports."""
    t = table(spark, d, "embedded_lyrics").select("lyrics_id", "origin").dropDuplicates(["lyrics_id"])
    timing = F.when(F.col("origin").contains("syncedlyrics") & ~F.col("origin").contains("unsynced"), "authored").when(F.col("origin").endswith("-estimated"), "estimated").otherwise("unknown")
    return t.select("lyrics_id", timing.alias("timing"))


def s14_look_ahead(spark, d):
    """Most notes that come up within the four seconds after a probe, for each run (from 0.22 s before it)."""
    hit = J.stabs(load_notes(spark, d), F.col("start") - 4.0, F.col("start") + 0.22, 5.0).where((F.col("start") - 4.0 <= F.col("t")) & (F.col("t") < F.col("start") + 0.22))
    return hit.groupBy("run_id", "t").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.max("n").alias("most"))


def h23_parse_time(spark, d):
    """Clock texts of people as seconds: mm:ss, or seconds alone; null for another form."""
    m = table(spark, d, "media_metadata").select("song_id", "duration").dropDuplicates(["song_id"])
    said = F.when(F.col("song_id") % 3 == 0, F.concat(F.floor(F.col("song_id") / 60).cast("string"), F.lit(":"), F.lpad((F.col("song_id") % 60).cast("string"), 2, "0"))).when(F.col("song_id") % 3 == 1, F.col("song_id").cast("string")).otherwise("soon")
    return m.select("song_id", F.coalesce(X.clock_seconds(said), said.try_cast("double")).alias("seconds"))


def f11_tie_order(spark, d):
    """Of the notes that tie in a group for the most confidence, the one that the tie rule (higher pitch) takes."""
    g = grouped(spark, d)
    w = W.partitionBy("run_id", "anchor").orderBy(F.desc("confidence"), F.desc("pitch"), "start", "end")
    ties = F.count("*").over(W.partitionBy("run_id", "anchor", "confidence"))
    return g.withColumn("ties", ties).withColumn("r", F.row_number().over(w)).where("r = 1 AND ties > 1").select("run_id", "anchor", "pitch", "ties")


def rollup_report(spark, d):
    """Sheets by origin and format with subtotals (grouping sets)."""
    t = table(spark, d, "embedded_lyrics").select("lyrics_id", "origin", "text").dropDuplicates(["lyrics_id"])
    t = t.withColumn("content", F.when(F.col("text").rlike(r"\S"), "text").otherwise("blank"))
    return t.rollup("origin", "content").agg(F.count("*").alias("sheets")).fillna("all", ["origin", "content"])


QUERIES = {f.__name__: f for f in (b5_filter_cues, b10_word_cleaning, d7_lower_median, d8_hand_median, j12_position_pairs, a24_json_cues, a25_provenance, s14_look_ahead, h23_parse_time, f11_tie_order, rollup_report)}
ORACLES = {
    "b5_filter_cues": rf"""WITH {CUES_SQL}, {WORDS_SQL}, w AS (SELECT cue_id, unnest(string_split_regex(lower(trim(text)), '\s+')) AS tok, generate_subscripts(string_split_regex(lower(trim(text)), '\s+'), 1) AS ix FROM cues_c), l AS (SELECT *, coalesce((lag(tok) OVER (PARTITION BY cue_id ORDER BY ix) <> tok)::INT, 0) AS cut FROM w), i AS (SELECT *, sum(cut) OVER (PARTITION BY cue_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS isl FROM l), r AS (SELECT cue_id, max(n) AS repeats FROM (SELECT cue_id, isl, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT c.* FROM cues_c c JOIN r USING (cue_id) WHERE repeats <= 16 AND trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) <> '')
SELECT cue_id FROM k WHERE NOT EXISTS (SELECT 1 FROM words_c w WHERE w.attempt_id = k.attempt_id AND w."end" > w.start) OR EXISTS (SELECT 1 FROM words_c w WHERE w.attempt_id = k.attempt_id AND w."end" > w.start AND least(w."end", k."end") > greatest(w.start, k.start))""",
    "b10_word_cleaning": "WITH t AS (SELECT DISTINCT word_id, attempt_id, start_s, end_s, text FROM lyric_words), b AS (SELECT *, start_s IS NULL OR isnan(start_s) OR start_s < 0 OR trim(coalesce(text, '')) = '' AS bad FROM t) SELECT attempt_id, count(*) FILTER (NOT bad) AS kept, count(*) FILTER (bad) AS ignored, round(sum(greatest(coalesce(end_s, start_s), start_s) - start_s) FILTER (NOT bad), 4) AS seconds FROM b GROUP BY 1",
    "d7_lower_median": f"WITH {_LF} SELECT run_id, quantile_disc(fret, 0.5)::INT AS centre FROM lf WHERE fret >= 1 GROUP BY 1",
    "d8_hand_median": f"WITH RECURSIVE {SELECTED_SQL}, {TUNING_SQL}, l AS (SELECT run_id, anchor, pitch, min(pitch - open) AS fret FROM chosen JOIN tuning ON pitch - open BETWEEN 0 AND 20 GROUP BY 1, 2, 3) SELECT run_id, anchor, median(fret)::DOUBLE AS hand FROM l WHERE fret > 0 GROUP BY 1, 2",
    "j12_position_pairs": f"WITH RECURSIVE {SELECTED_SQL}, {TUNING_SQL}, p AS (SELECT run_id, anchor, pitch, string, pitch - open AS fret FROM chosen JOIN tuning ON pitch - open BETWEEN 0 AND 20) SELECT a.run_id, a.anchor, count(*) AS pairs FROM p a JOIN p b ON a.run_id = b.run_id AND a.anchor = b.anchor AND a.pitch < b.pitch AND a.string <> b.string AND (a.fret = 0 OR b.fret = 0 OR abs(a.fret - b.fret) <= 5) GROUP BY 1, 2",
    "a24_json_cues": "WITH c AS (SELECT DISTINCT cue_id, attempt_id, start_s, end_s, text FROM raw_cues WHERE start_s IS NOT NULL AND NOT isnan(start_s) AND text IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(end_s)) SELECT attempt_id, CASE WHEN bool_and(start_s >= 0 AND end_s >= start_s) THEN count(*) ELSE 0 END AS cues, CASE WHEN NOT bool_and(start_s >= 0 AND end_s >= start_s) THEN 'malformed cue' END AS reject FROM c GROUP BY 1",
    "a25_provenance": f"WITH {_LY} SELECT lyrics_id, CASE WHEN contains(origin, 'syncedlyrics') AND NOT contains(origin, 'unsynced') THEN 'authored' WHEN origin LIKE '%-estimated' THEN 'estimated' ELSE 'unknown' END AS timing FROM ly",
    "s14_look_ahead": f'WITH {NOTES_SQL}, p AS (SELECT run_id, unnest(generate_series(0, CAST(ceil(max("end") / 5) AS BIGINT) + 1)) * 5.0::DOUBLE AS t FROM notes_c GROUP BY 1), h AS (SELECT p.run_id, p.t, count(*) AS n FROM p JOIN notes_c n ON n.run_id = p.run_id AND n.start - 4.0 <= p.t AND p.t < n.start + 0.22::DOUBLE GROUP BY 1, 2) SELECT run_id, max(n) AS most FROM h GROUP BY 1',
    "h23_parse_time": "WITH m AS (SELECT DISTINCT song_id FROM media_metadata) SELECT song_id, CASE WHEN song_id % 3 < 2 AND (song_id % 3 = 1 OR song_id < 60000) THEN song_id::DOUBLE END AS seconds FROM m",
    "f11_tie_order": f'WITH RECURSIVE {GROUPS_SQL} SELECT run_id, anchor, pitch, ties FROM (SELECT *, count(*) OVER (PARTITION BY run_id, anchor, confidence) AS ties, row_number() OVER (PARTITION BY run_id, anchor ORDER BY confidence DESC, pitch DESC, start, "end") AS r FROM groups_c) WHERE r = 1 AND ties > 1',
    "rollup_report": f"WITH {_LY}, b AS (SELECT lyrics_id, origin, CASE WHEN regexp_matches(text, '\\S') THEN 'text' ELSE 'blank' END AS content FROM ly) SELECT coalesce(origin, 'all') AS origin, coalesce(content, 'all') AS content, count(*) AS sheets FROM b GROUP BY ROLLUP (origin, content)",
}
