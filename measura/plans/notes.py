"""Queries over note events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions.music import TUNINGS, chord_name, class_name, template_masks
from measura.operators import notes as N
from measura.sources.bind import NOTES_SQL, load_notes

TUNING_SQL = "tuning(string, open) AS (VALUES " + ", ".join(f"({i}, {t})" for i, t in enumerate(TUNINGS["standard"])) + ")"
MERGED_SQL = f"""{NOTES_SQL},
floor_c AS (SELECT * FROM notes_c WHERE confidence >= 0.5),
reach_c AS (SELECT *, max("end") OVER (PARTITION BY run_id, pitch ORDER BY start, "end", confidence DESC, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM floor_c),
isl_c AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 0.15::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, pitch ORDER BY start, "end", confidence DESC, note_id ROWS UNBOUNDED PRECEDING) AS island FROM reach_c),
merged AS (SELECT run_id, pitch, min(start) AS start, max("end") AS "end", max(confidence) AS confidence, count(*) AS merged FROM isl_c GROUP BY run_id, pitch, island)"""
GROUPS_SQL = f"""{MERGED_SQL},
ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start, "end", pitch, confidence) AS rn FROM merged),
anchored AS (SELECT run_id, rn, start AS anchor FROM ordered WHERE rn = 1
 UNION ALL SELECT o.run_id, o.rn, CASE WHEN o.start - a.anchor <= 0.09::DOUBLE THEN a.anchor ELSE o.start END FROM anchored a JOIN ordered o ON o.run_id = a.run_id AND o.rn = a.rn + 1),
groups_c AS (SELECT o.run_id, o.start, o."end", o.pitch, o.confidence, a.anchor FROM ordered o JOIN anchored a USING (run_id, rn))"""
SELECTED_SQL = f"""{GROUPS_SQL},
one AS (SELECT * FROM groups_c QUALIFY row_number() OVER (PARTITION BY run_id, anchor, pitch ORDER BY confidence DESC, start, "end") = 1),
chosen AS (SELECT * FROM one WHERE pitch BETWEEN 40 AND 84 QUALIFY row_number() OVER (PARTITION BY run_id, anchor ORDER BY confidence DESC, pitch DESC) <= 4)"""
_CLASS = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
CHORDS_SQL = f"""{SELECTED_SQL},
tmpl(mask, rnk, suffix) AS (VALUES {", ".join(f"({m}, {r}, '{s}')" for m, r, s in template_masks())}),
sets AS (SELECT run_id, anchor, min(pitch) % 12 AS bass, list_sort(list_distinct(list(pitch % 12))) AS pcs FROM chosen GROUP BY run_id, anchor),
roots AS (SELECT *, unnest(pcs) AS root FROM sets),
masks AS (SELECT *, list_sum(list_transform(pcs, lambda p: 1 << CAST((p - root + 12) % 12 AS INT))) AS mask FROM roots),
hits AS (SELECT m.*, t.suffix FROM masks m JOIN tmpl t ON t.mask = m.mask WHERE len(pcs) BETWEEN 3 AND 4 QUALIFY row_number() OVER (PARTITION BY run_id, anchor ORDER BY (root <> bass)::INT, rnk, root) = 1),
dyads AS (SELECT *, CASE pcs[2] - pcs[1] WHEN 7 THEN pcs[1] WHEN 5 THEN pcs[2] END AS root FROM sets WHERE len(pcs) = 2),
named AS (SELECT run_id, anchor, bass, root, {_CLASS}[root + 1] || suffix AS base FROM hits UNION ALL SELECT run_id, anchor, bass, root, {_CLASS}[root + 1] || '5' FROM dyads WHERE root IS NOT NULL),
chords AS (SELECT run_id, anchor, base || CASE WHEN root <> bass THEN '/' || {_CLASS}[bass + 1] ELSE '' END AS chord FROM named)"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    return N.restart_merge(load_notes(spark, d).where(F.col("confidence") >= N.FLOOR), "run_id")


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return N.onset_groups(merged(spark, d), "run_id")


def selected(spark: SparkSession, d: str) -> DataFrame:
    return N.strongest(grouped(spark, d).where(N.playable(F.col("pitch"))), ["run_id", "anchor"])


def chords(spark: SparkSession, d: str) -> DataFrame:
    sets = selected(spark, d).groupBy("run_id", "anchor").agg(F.collect_list("pitch").alias("pitches"))
    return sets.select("run_id", "anchor", chord_name(F.col("pitches")).alias("chord")).where("chord IS NOT NULL")


def a14_load_notes(spark, d):
    return load_notes(spark, d).select("note_id", "run_id", "start", "end", "pitch", "confidence")


def b1_confidence_floor(spark, d):
    n = load_notes(spark, d)
    return n.groupBy("run_id").agg(F.count_if(F.col("confidence") >= N.FLOOR).alias("kept"), F.count_if(F.col("confidence") < N.FLOOR).alias("removed"))


def b2_positions(spark, d):
    return N.positions(load_notes(spark, d)).select("note_id", "pitch", "string", "fret")


def b3_playable(spark, d):
    return load_notes(spark, d).groupBy("run_id").agg(F.count_if(N.playable(F.col("pitch"))).alias("playable"), F.count("*").alias("notes"))


def d2_restart_merge(spark, d):
    return merged(spark, d)


def d1_onset_groups(spark, d):
    return grouped(spark, d).groupBy("run_id", "anchor").agg(F.count("*").alias("notes"), F.min("start").alias("start"), F.max("end").alias("end"))


def d3_strongest_per_pitch(spark, d):
    return N.strongest(grouped(spark, d), ["run_id", "anchor"], 128).select("run_id", "anchor", "pitch", "confidence")


def f2_top_polyphony(spark, d):
    return selected(spark, d).select("run_id", "anchor", "pitch", "confidence")


def d4_omissions(spark, d):
    """Notes of each run that the selection leaves out; kept and omitted notes add up to the input."""
    groups = grouped(spark, d)
    kept = selected(spark, d).groupBy("run_id").agg(F.count("*").alias("kept"))
    return groups.groupBy("run_id").agg(F.count("*").alias("total")).join(kept, "run_id", "left").select("run_id", "total", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total") - F.coalesce("kept", F.lit(0))).alias("omitted"))


def d16_pitch_classes(spark, d):
    g = selected(spark, d).groupBy("run_id", "anchor").agg(F.collect_set(F.col("pitch") % 12).alias("pcs"), (F.min("pitch") % 12).alias("bass"))
    return g.select("run_id", "anchor", F.array_join(F.transform(F.array_sort("pcs"), lambda p: p.cast("string")), " ").alias("pcs"), "bass")


def g5_template_match(spark, d):
    """How many onset groups match each chord name."""
    return chords(spark, d).groupBy("chord").agg(F.count("*").alias("groups"), F.count_distinct("run_id").alias("runs"))


def h26_chord_names(spark, d):
    return chords(spark, d)


def h27_event_labels(spark, d):
    """Chord name of each group, or the distinct class names in ascending order."""
    sets = selected(spark, d).groupBy("run_id", "anchor").agg(F.collect_list("pitch").alias("pitches"))
    spelled = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("pitches", lambda p: p % 12))), class_name), " ")
    return sets.select("run_id", "anchor", F.coalesce(chord_name(F.col("pitches")), spelled).alias("label"))


def f1_note_order(spark, d):
    w = W.partitionBy("run_id").orderBy("start", "end", "pitch", "confidence", "note_id")
    return load_notes(spark, d).select("run_id", "note_id", F.row_number().over(w).cast("long").alias("place"))


def d5_density(spark, d, buckets: int = 192):
    """Share of the busiest bucket for each of 192 buckets over the span of a run; notes out of range are dropped."""
    n = load_notes(spark, d)
    span = n.groupBy("run_id").agg(F.max("end").alias("span"))
    b = n.join(span, "run_id").withColumn("bucket", F.floor(F.col("start") / F.col("span") * buckets)).where(F.col("bucket").between(0, buckets - 1))
    c = b.groupBy("run_id", "bucket").agg(F.least(F.count("*"), F.lit(65535)).alias("notes"))
    return c.withColumn("share", F.round(F.col("notes") / F.max("notes").over(W.partitionBy("run_id")), 9))


def d6_minimap(spark, d, columns: int = 120):
    """Notes for each of 120 columns over the span of a run; notes beyond it count in the last column."""
    n = load_notes(spark, d)
    span = n.groupBy("run_id").agg(F.max("start").alias("span"))
    col = F.least(F.greatest(F.floor(F.when(F.col("span") > 0, F.col("start") / F.col("span")).otherwise(0.0) * columns), F.lit(0)), F.lit(columns - 1))
    return n.join(span, "run_id").groupBy("run_id", col.alias("column")).agg(F.count("*").alias("notes"))


def d18_longest_note(spark, d):
    return load_notes(spark, d).groupBy("run_id").agg(F.max(F.col("end") - F.col("start")).alias("longest"))


def g1_playable_pitches(spark, d):
    reach = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.sequence(F.lit(t), F.lit(t + N.MAX_FRET)) for t in TUNINGS["standard"])))))
    return spark.range(1).select(F.explode(reach).alias("pitch"))


def a33_overlap_bound(spark, d, most: int = 256):
    """Notes that start before the note ``most`` places earlier in their run has ended."""
    w = W.partitionBy("run_id").orderBy("start", "end", "pitch", "confidence", "note_id")
    return load_notes(spark, d).withColumn("back", F.lag("end", most).over(w)).groupBy("run_id").agg(F.count_if(F.col("back") > F.col("start")).alias("violations"))


def e19_dense_ids(spark, d):
    w = W.partitionBy("run_id").orderBy("start", "end", "pitch", "confidence", "note_id")
    return load_notes(spark, d).select("note_id", (F.row_number().over(w) - 1).cast("long").alias("dense_id"))


def b16_below_capo(spark, d, capo: int = 3):
    return N.positions(load_notes(spark, d)).groupBy("run_id").agg(F.count_if((F.col("fret") > 0) & (F.col("fret") < capo)).alias("below_capo"))


def e14_release_reused_strings(spark, d):
    """End of each note on its lowest string, cut at the next later onset on that string."""
    low = N.positions(load_notes(spark, d)).withColumn("r", F.row_number().over(W.partitionBy("note_id").orderBy("fret"))).where("r = 1")
    starts = low.groupBy("run_id", "string", "start").agg(F.count("*").alias("n")).withColumn("next", F.lead("start").over(W.partitionBy("run_id", "string").orderBy("start")))
    out = low.join(starts.drop("n"), ["run_id", "string", "start"])
    return out.select("note_id", "string", "fret", F.when(F.col("next") < F.col("end"), F.col("next")).otherwise(F.col("end")).alias("end"))


QUERIES = {f.__name__: f for f in (d2_restart_merge, a14_load_notes, b1_confidence_floor, b2_positions, b3_playable, d1_onset_groups, d3_strongest_per_pitch, f2_top_polyphony, d4_omissions, d16_pitch_classes, g5_template_match, h26_chord_names, h27_event_labels, f1_note_order, d5_density, d6_minimap, d18_longest_note, g1_playable_pitches, a33_overlap_bound, e19_dense_ids, b16_below_capo, e14_release_reused_strings)}
_ORDER = 'OVER (PARTITION BY run_id ORDER BY start, "end", pitch, confidence, note_id)'
_POS = f"{NOTES_SQL}, {TUNING_SQL}, pos AS (SELECT n.*, t.string, n.pitch - t.open AS fret FROM notes_c n JOIN tuning t ON n.pitch - t.open BETWEEN 0 AND 20)"
ORACLES = {
    "d2_restart_merge": f"WITH {MERGED_SQL} SELECT * FROM merged",
    "a14_load_notes": f'WITH {NOTES_SQL} SELECT note_id, run_id, start, "end", pitch, confidence FROM notes_c',
    "b1_confidence_floor": f"WITH {NOTES_SQL} SELECT run_id, count(*) FILTER (confidence >= 0.5) AS kept, count(*) FILTER (confidence < 0.5) AS removed FROM notes_c GROUP BY 1",
    "b2_positions": f"WITH {_POS} SELECT note_id, pitch, string, fret FROM pos",
    "b3_playable": f"WITH {NOTES_SQL} SELECT run_id, count(*) FILTER (pitch BETWEEN 40 AND 84) AS playable, count(*) AS notes FROM notes_c GROUP BY 1",
    "d1_onset_groups": f'WITH RECURSIVE {GROUPS_SQL} SELECT run_id, anchor, count(*) AS notes, min(start) AS start, max("end") AS "end" FROM groups_c GROUP BY 1, 2',
    "d3_strongest_per_pitch": f"WITH RECURSIVE {SELECTED_SQL} SELECT run_id, anchor, pitch, confidence FROM one",
    "f2_top_polyphony": f"WITH RECURSIVE {SELECTED_SQL} SELECT run_id, anchor, pitch, confidence FROM chosen",
    "d4_omissions": f"WITH RECURSIVE {SELECTED_SQL}, k AS (SELECT run_id, count(*) AS kept FROM chosen GROUP BY 1), t AS (SELECT run_id, count(*) AS total FROM groups_c GROUP BY 1) SELECT run_id, total, coalesce(kept, 0) AS kept, total - coalesce(kept, 0) AS omitted FROM t LEFT JOIN k USING (run_id)",
    "d16_pitch_classes": f"WITH RECURSIVE {CHORDS_SQL} SELECT run_id, anchor, array_to_string(pcs, ' ') AS pcs, bass FROM sets",
    "g5_template_match": f"WITH RECURSIVE {CHORDS_SQL} SELECT chord, count(*) AS groups, count(DISTINCT run_id) AS runs FROM chords GROUP BY 1",
    "h26_chord_names": f"WITH RECURSIVE {CHORDS_SQL} SELECT * FROM chords",
    "h27_event_labels": f"WITH RECURSIVE {CHORDS_SQL} SELECT s.run_id, s.anchor, coalesce(c.chord, array_to_string(list_transform(s.pcs, lambda p: {_CLASS}[p + 1]), ' ')) AS label FROM sets s LEFT JOIN chords c ON c.run_id = s.run_id AND c.anchor = s.anchor",
    "f1_note_order": f"WITH {NOTES_SQL} SELECT run_id, note_id, row_number() {_ORDER} AS place FROM notes_c",
    "d5_density": f'WITH {NOTES_SQL}, s AS (SELECT run_id, max("end") AS span FROM notes_c GROUP BY 1), b AS (SELECT n.run_id, CAST(floor(start / span * 192) AS BIGINT) AS bucket FROM notes_c n JOIN s USING (run_id)), c AS (SELECT run_id, bucket, least(count(*), 65535) AS notes FROM b WHERE bucket BETWEEN 0 AND 191 GROUP BY 1, 2) SELECT *, round(notes / max(notes) OVER (PARTITION BY run_id), 9) AS share FROM c',
    "d6_minimap": f'WITH {NOTES_SQL}, s AS (SELECT run_id, max(start) AS span FROM notes_c GROUP BY 1) SELECT n.run_id, least(greatest(CAST(floor(CASE WHEN span > 0 THEN start / span ELSE 0 END * 120) AS BIGINT), 0), 119) AS "column", count(*) AS notes FROM notes_c n JOIN s USING (run_id) GROUP BY 1, 2',
    "d18_longest_note": f'WITH {NOTES_SQL} SELECT run_id, max("end" - start) AS longest FROM notes_c GROUP BY 1',
    "g1_playable_pitches": "SELECT unnest(generate_series(40, 84))::INT AS pitch",
    "a33_overlap_bound": f'WITH {NOTES_SQL}, b AS (SELECT run_id, start, lag("end", 256) {_ORDER} AS back FROM notes_c) SELECT run_id, count(*) FILTER (back > start) AS violations FROM b GROUP BY 1',
    "e19_dense_ids": f"WITH {NOTES_SQL} SELECT note_id, row_number() {_ORDER} - 1 AS dense_id FROM notes_c",
    "b16_below_capo": f"WITH {_POS} SELECT run_id, count(*) FILTER (fret > 0 AND fret < 3) AS below_capo FROM pos GROUP BY 1",
    "e14_release_reused_strings": f'WITH {_POS}, low AS (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY fret) = 1), st AS (SELECT run_id, string, start, lead(start) OVER (PARTITION BY run_id, string ORDER BY start) AS nxt FROM (SELECT DISTINCT run_id, string, start FROM low)) SELECT l.note_id, l.string, l.fret, CASE WHEN st.nxt < l."end" THEN st.nxt ELSE l."end" END AS "end" FROM low l JOIN st ON st.run_id = l.run_id AND st.string = l.string AND st.start = l.start',
}
