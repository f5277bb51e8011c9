"""Queries that look things up in time or join tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.operators import interval_joins as J
from measura.operators import notes as N
from measura.plans.notes import _POS
from measura.session import table
from measura.sources.bind import CUES_SQL, NOTES_SQL, WORDS_SQL, load_cues, load_notes, load_words


def _cue_probes(spark, d, step=5.0):
    return J.grid(load_cues(spark, d).groupBy("attempt_id").agg(F.max("end").alias("e")), "attempt_id", "e", step)


def _note_probes(spark, d, step=5.0):
    return J.grid(load_notes(spark, d).groupBy("run_id").agg(F.max("end").alias("e")), "run_id", "e", step)


def j1_cue_at(spark, d):
    """The cue that sounds at each probe: the newest that began, if it hasn't ended (half-open)."""
    hit = J.as_of(_cue_probes(spark, d), load_cues(spark, d), "attempt_id", "t", "start", "cue_id", ["cue_id", "end"])
    return hit.select("attempt_id", "t", F.when(F.col("t") < F.col("end"), F.col("cue_id")).alias("cue_id"))


def j2_word_at(spark, d):
    """The word that sounds in the middle of each cue that has words."""
    words = load_words(spark, d)
    cues = load_cues(spark, d).join(words.select("cue_id"), "cue_id", "left_semi").select("cue_id", ((F.col("start") + F.col("end")) / 2).alias("t"))
    hit = J.as_of(cues, words, "cue_id", "t", "start", "word_id", ["word_id", "end"])
    return hit.select("cue_id", F.when(F.col("t") < F.col("end"), F.col("word_id")).alias("word_id"))


def j3_first_after(spark, d):
    """The first note, in order, that ends after each probe: where the running maximum of the ends first passes it."""
    w = W.partitionBy("run_id").orderBy("start", "end", "pitch", "confidence", "note_id")
    n = load_notes(spark, d).withColumn("ix", F.row_number().over(w).cast("long")).withColumn("reach", F.max("end").over(w.rowsBetween(W.unboundedPreceding, 0)))
    steps = n.groupBy("run_id", "reach").agg(F.min("ix").alias("ix"))
    return J.next_of(_note_probes(spark, d, 10.0), steps, "run_id", "t", "reach", "ix", ["ix"]).where("ix IS NOT NULL")


def j4_notes_at(spark, d, lead: float = 2.0, capacity: int = 8):
    """Notes that sound or come within two seconds at each probe: the first eight in order, with progress."""
    w = W.partitionBy("run_id").orderBy("start", "end", "pitch", "confidence", "note_id")
    n = load_notes(spark, d).withColumn("ix", F.row_number().over(w))
    hit = J.stabs(n, F.col("start") - lead, F.col("end"), 5.0)
    place = F.row_number().over(W.partitionBy("run_id", "t").orderBy("ix")).cast("long")
    sounding = F.col("start") <= F.col("t")
    out = hit.withColumn("place", place).withColumn("total", F.count("*").over(W.partitionBy("run_id", "t"))).where(F.col("place") <= capacity)
    progress = F.when(sounding, F.round((F.col("t") - F.col("start")) / (F.col("end") - F.col("start")), 6))
    return out.select("run_id", "t", "note_id", "place", "total", F.when(sounding, "sounding").otherwise("approaching").alias("state"), progress.alias("progress"), F.when(~sounding, F.round(F.col("start") - F.col("t"), 6)).alias("time_to_start"))


def d17_report_counts(spark, d, lead: float = 2.0, capacity: int = 8):
    hit = J.stabs(load_notes(spark, d), F.col("start") - lead, F.col("end"), 5.0)
    sounding = F.col("start") <= F.col("t")
    return hit.groupBy("run_id", "t").agg(F.count("*").alias("total"), F.count_if(sounding).alias("sounding"), F.count_if(~sounding).alias("approaching"), F.count_if(~N.playable(F.col("pitch"))).alias("out_of_range"), (F.count("*") > capacity).alias("truncated"))


def _low_frets(spark, d):
    return N.positions(load_notes(spark, d)).groupBy("run_id", "note_id", "start", "end").agg(F.min("fret").alias("fret"))


def j5_hand_window(spark, d, max_fret: int = N.MAX_FRET):
    """Hand box at each probe: lower median of the fretted frets of notes that touch [t - 0.5, t + 1.5), two frets either side."""
    hit = J.stabs(_low_frets(spark, d), F.col("start") - 1.5, F.col("end") + 0.5, 5.0).where((F.col("end") > F.col("t") - 0.5) & (F.col("start") < F.col("t") + 1.5) & (F.col("fret") >= 1))
    mid = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY fret)").cast("int")
    low = F.greatest(F.least(F.col("mid") - 2, F.lit(max_fret - 4)), F.lit(1))
    return hit.groupBy("run_id", "t").agg(mid.alias("mid")).select("run_id", "t", low.alias("low"), (low + 4).alias("high"))


def j6_overlaps_speech(spark, d):
    """Cues that overlap a timed word of their attempt."""
    cues, words = load_cues(spark, d).select("attempt_id", "cue_id", "start", "end"), load_words(spark, d).where("end > start").select("attempt_id", F.col("start").alias("ws"), F.col("end").alias("we"))
    return J.overlap_join(cues, words, "attempt_id", ("start", "end"), ("ws", "we"), 4.0, "left_semi").select("cue_id")


def _sections(spark, d):
    """A section begins at every tenth cue of an attempt and ends where the next begins, the last with the attempt."""
    w = W.partitionBy("attempt_id").orderBy("start", "end", "cue_id")
    c = load_cues(spark, d).withColumn("n", F.row_number().over(w)).withColumn("last", F.max("end").over(W.partitionBy("attempt_id")))
    s = c.where("n % 10 = 1").withColumn("section", ((F.col("n") - 1) / 10).cast("int"))
    return s.select("attempt_id", "section", F.col("start").alias("from_s"), F.lead("start", 1).over(W.partitionBy("attempt_id").orderBy("section")).alias("nxt"), "last").select("attempt_id", "section", "from_s", F.coalesce("nxt", "last").alias("to_s"))


def e16_section_ends(spark, d):
    return _sections(spark, d)


def j7_cues_in_sections(spark, d):
    """Each cue in every section it overlaps."""
    cues = load_cues(spark, d).select("attempt_id", "cue_id", "start", "end")
    return J.overlap_join(cues, _sections(spark, d).where("to_s > from_s"), "attempt_id", ("start", "end"), ("from_s", "to_s"), 8.0).select("cue_id", "section")


def j8_section_at(spark, d):
    """The section at each probe; before the first and past the last, the last section."""
    s = _sections(spark, d)
    hit = J.as_of(_cue_probes(spark, d), s, "attempt_id", "t", "from_s", "section", ["section", "to_s"])
    last = s.groupBy("attempt_id").agg(F.max("section").alias("last"))
    return hit.join(last, "attempt_id").select("attempt_id", "t", F.coalesce(F.when(F.col("t") < F.col("to_s"), F.col("section")), "last").alias("section"))


def j9_all_sounding(spark, d):
    """How many cues sound at each probe, not just the newest."""
    return J.stabs(load_cues(spark, d), F.col("start"), F.col("end"), 5.0).groupBy("attempt_id", "t").agg(F.count("*").alias("cues"), F.max("cue_id").alias("newest_id"))


def j10_next_move(spark, d):
    """The first note after each probe whose fret is two or more away from the low end of the hand box, within four seconds."""
    hands = j5_hand_window(spark, d)
    ahead = J.stabs(_low_frets(spark, d), F.col("start") - 4.0, F.col("start"), 5.0).where(F.col("fret") >= 1)
    far = ahead.join(hands, ["run_id", "t"]).where(F.abs(F.col("fret") - F.col("low")) >= 2)
    return far.groupBy("run_id", "t").agg(F.min_by("note_id", F.struct("start", "note_id")).alias("note_id"), F.min("start").alias("start"))


def j11_previous_next(spark, d):
    """Starts to jump to from each probe: the first after t + 0.01, the last before t - 0.25 (else 0)."""
    cues = load_cues(spark, d)
    p = _cue_probes(spark, d).withColumns({"ahead": F.col("t") + F.lit(0.01), "behind": F.col("t") - F.lit(0.25) - F.lit(1e-9)})
    one = J.next_of(p, cues, "attempt_id", "ahead", "start", "cue_id", ["start"]).withColumnRenamed("start", "next_start")
    two = J.as_of(one, cues, "attempt_id", "behind", "start", "cue_id", ["start"])
    return two.select("attempt_id", "t", "next_start", F.coalesce("start", F.lit(0.0)).alias("previous_start"))


def _attempts(spark, d):
    return table(spark, d, "attempts").select("attempt_id", "song_id", "audio_source", "language_code").distinct()


def j15_source_fallback(spark, d):
    """For each song the first attempt of the vocal source, else of any other."""
    a = _attempts(spark, d)
    first = lambda df, name: df.groupBy("song_id").agg(F.min("attempt_id").alias(name))
    vocal, other = first(a.where("audio_source = 'vocals'"), "vocal"), first(a.where("coalesce(audio_source, '') <> 'vocals'"), "other")
    songs = a.select("song_id").distinct()
    return songs.join(vocal, "song_id", "left").join(other, "song_id", "left").select("song_id", F.coalesce("vocal", "other").alias("attempt_id"))


def j16_dimension_join(spark, d):
    """Attempts by label of their source, from a literal dimension with a default."""
    dim = spark.createDataFrame([("vocals", "Vocals", "stem"), ("mix", "Full mix", "mix")], "audio_source string, label string, kind string")
    a = _attempts(spark, d).join(F.broadcast(dim), "audio_source", "left")
    return a.groupBy(F.coalesce("label", F.initcap("audio_source"), F.lit("Unknown")).alias("label"), F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("attempts"))


def j17_unused_tags(spark, d):
    """Ignored tags of the songs that no song uses as its title or artist tag."""
    m = table(spark, d, "media_metadata")
    used = m.select(F.lower("title_tag").alias("tag")).union(m.select(F.lower("artist_tag"))).where("tag IS NOT NULL").distinct()
    tags = m.select("song_id", F.explode("ignored_tags").alias("tag")).distinct().withColumn("tag", F.lower("tag"))
    return tags.join(used, "tag", "left_anti").groupBy("tag").agg(F.count_distinct("song_id").alias("songs"))


def j18_missing_references(spark, d):
    """Songs whose lyrics or attempts stand without a song in the catalogue."""
    songs = table(spark, d, "media_metadata").select("song_id", F.lit(True).alias("there")).distinct()
    parts = [table(spark, d, t).select(F.lit(t).alias("source"), "song_id").distinct() for t in ("attempts", "embedded_lyrics", "notes")]
    used = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(songs, "song_id", "left")
    return used.groupBy("source").agg(F.count("*").alias("songs"), F.count_if(F.col("there").isNull()).alias("missing"))


def j20_first_near(spark, d):
    """The first note that starts at or after t minus the longest note of the run minus 0.5 s."""
    longest = load_notes(spark, d).groupBy("run_id").agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    p = _note_probes(spark, d, 10.0).join(longest, "run_id").withColumn("seek", F.col("t") - F.col("longest") - F.lit(0.5) - F.lit(1e-9))
    return J.next_of(p, load_notes(spark, d), "run_id", "seek", "start", "note_id", ["start"]).select("run_id", "t", F.col("start").alias("first_start"))


QUERIES = {f.__name__: f for f in (j1_cue_at, j2_word_at, j3_first_after, j4_notes_at, d17_report_counts, j5_hand_window, j6_overlaps_speech, e16_section_ends, j7_cues_in_sections, j8_section_at, j9_all_sounding, j10_next_move, j11_previous_next, j15_source_fallback, j16_dimension_join, j17_unused_tags, j18_missing_references, j20_first_near)}

_CP = f"{CUES_SQL}, p AS (SELECT attempt_id, unnest(generate_series(0, CAST(floor(max(\"end\") / 5.0::DOUBLE) AS BIGINT))) * 5.0::DOUBLE AS t FROM cues_c GROUP BY attempt_id)"
_NP = lambda step: f"{NOTES_SQL}, p AS (SELECT run_id, unnest(generate_series(0, CAST(floor(max(\"end\") / {step}::DOUBLE) AS BIGINT))) * {step}::DOUBLE AS t FROM notes_c GROUP BY run_id)"
_IX = 'row_number() OVER (PARTITION BY run_id ORDER BY start, "end", pitch, confidence, note_id)'
_LF = f'{_POS}, lf AS (SELECT run_id, note_id, start, "end", min(fret) AS fret FROM pos GROUP BY ALL), p AS (SELECT run_id, unnest(generate_series(0, CAST(ceil(max("end") / 5) AS BIGINT) + 1)) * 5.0::DOUBLE AS t FROM notes_c GROUP BY run_id)'
_HAND = f'{_LF}, hw AS (SELECT p.run_id, p.t, quantile_disc(fret, 0.5) AS mid FROM p JOIN lf ON lf.run_id = p.run_id AND lf."end" > p.t - 0.5 AND lf.start < p.t + 1.5 WHERE fret >= 1 GROUP BY 1, 2), hand AS (SELECT run_id, t, greatest(least(mid - 2, 16), 1) AS low, greatest(least(mid - 2, 16), 1) + 4 AS high FROM hw)'
_SEC = f"""{CUES_SQL}, sc AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY start, "end", cue_id) AS n, max("end") OVER (PARTITION BY attempt_id) AS last FROM cues_c),
sections AS (SELECT attempt_id, CAST((n - 1) / 10 AS INT) AS section, start AS from_s, coalesce(lead(start) OVER (PARTITION BY attempt_id ORDER BY n), last) AS to_s FROM sc WHERE n % 10 = 1)"""
ORACLES = {
    "j1_cue_at": f'WITH {_CP}, one AS (SELECT * FROM cues_c QUALIFY row_number() OVER (PARTITION BY attempt_id, start ORDER BY cue_id DESC) = 1) SELECT p.attempt_id, p.t, CASE WHEN p.t < o."end" THEN o.cue_id END AS cue_id FROM p ASOF LEFT JOIN one o ON o.attempt_id = p.attempt_id AND o.start <= p.t',
    "j2_word_at": f'WITH {CUES_SQL}, {WORDS_SQL}, q AS (SELECT cue_id, (start + "end") / 2 AS t FROM cues_c WHERE cue_id IN (SELECT cue_id FROM words_c)), one AS (SELECT * FROM words_c QUALIFY row_number() OVER (PARTITION BY cue_id, start ORDER BY word_id DESC) = 1) SELECT q.cue_id, CASE WHEN q.t < o."end" THEN o.word_id END AS word_id FROM q ASOF LEFT JOIN one o ON o.cue_id = q.cue_id AND o.start <= q.t',
    "j3_first_after": f'WITH {_NP(10.0)}, i AS (SELECT *, {_IX} AS ix FROM notes_c) SELECT p.run_id, p.t, min(ix) AS ix FROM p JOIN i ON i.run_id = p.run_id AND i."end" > p.t GROUP BY 1, 2',
    "j4_notes_at": f"""WITH {NOTES_SQL}, p AS (SELECT run_id, unnest(generate_series(0, CAST(ceil(max("end") / 5) AS BIGINT))) * 5.0::DOUBLE AS t FROM notes_c GROUP BY run_id), i AS (SELECT *, {_IX} AS ix FROM notes_c), h AS (SELECT p.t, i.* FROM p JOIN i ON i.run_id = p.run_id AND i.start - 2.0 <= p.t AND p.t < i."end"),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, t ORDER BY ix) AS place, count(*) OVER (PARTITION BY run_id, t) AS total FROM h)
SELECT run_id, t, note_id, place, total, CASE WHEN start <= t THEN 'sounding' ELSE 'approaching' END AS state, CASE WHEN start <= t THEN round((t - start) / ("end" - start), 6) END AS progress, CASE WHEN start > t THEN round(start - t, 6) END AS time_to_start FROM r WHERE place <= 8""",
    "d17_report_counts": f"""WITH {NOTES_SQL}, p AS (SELECT run_id, unnest(generate_series(0, CAST(ceil(max("end") / 5) AS BIGINT))) * 5.0::DOUBLE AS t FROM notes_c GROUP BY run_id), h AS (SELECT p.t, i.* FROM p JOIN notes_c i ON i.run_id = p.run_id AND i.start - 2.0 <= p.t AND p.t < i."end")
SELECT run_id, t, count(*) AS total, count(*) FILTER (start <= t) AS sounding, count(*) FILTER (start > t) AS approaching, count(*) FILTER (pitch NOT BETWEEN 40 AND 84) AS out_of_range, count(*) > 8 AS truncated FROM h GROUP BY 1, 2""",
    "j5_hand_window": f"WITH {_HAND} SELECT run_id, t, low, high FROM hand",
    "j6_overlaps_speech": f'WITH {CUES_SQL}, {WORDS_SQL} SELECT cue_id FROM cues_c c WHERE EXISTS (SELECT 1 FROM words_c w WHERE w.attempt_id = c.attempt_id AND w."end" > w.start AND least(w."end", c."end") > greatest(w.start, c.start))',
    "e16_section_ends": f"WITH {_SEC} SELECT * FROM sections",
    "j7_cues_in_sections": f'WITH {_SEC} SELECT c.cue_id, s.section FROM cues_c c JOIN sections s ON s.attempt_id = c.attempt_id AND least(s.to_s, c."end") > greatest(s.from_s, c.start)',
    "j8_section_at": f'WITH {_SEC}, p AS (SELECT attempt_id, unnest(generate_series(0, CAST(floor(max("end") / 5.0::DOUBLE) AS BIGINT))) * 5.0::DOUBLE AS t FROM cues_c GROUP BY attempt_id), o AS (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY attempt_id, from_s ORDER BY section DESC) = 1), l AS (SELECT attempt_id, max(section) AS last FROM sections GROUP BY 1) SELECT p.attempt_id, p.t, coalesce(CASE WHEN p.t < o.to_s THEN o.section END, l.last) AS section FROM p ASOF LEFT JOIN o ON o.attempt_id = p.attempt_id AND o.from_s <= p.t JOIN l ON l.attempt_id = p.attempt_id',
    "j9_all_sounding": f'WITH {_CP} SELECT p.attempt_id, p.t, count(*) AS cues, max(cue_id) AS newest_id FROM p JOIN cues_c c ON c.attempt_id = p.attempt_id AND c.start <= p.t AND p.t < c."end" GROUP BY 1, 2',
    "j10_next_move": f"WITH {_HAND} SELECT h.run_id, h.t, arg_min(lf.note_id, (lf.start, lf.note_id)) AS note_id, min(lf.start) AS start FROM hand h JOIN lf ON lf.run_id = h.run_id AND lf.start > h.t AND lf.start - 4.0 <= h.t WHERE fret >= 1 AND abs(fret - low) >= 2 GROUP BY 1, 2",
    "j11_previous_next": f"WITH {_CP} SELECT p.attempt_id, p.t, min(c.start) FILTER (c.start > p.t + 0.01::DOUBLE) AS next_start, coalesce(max(c.start) FILTER (c.start <= p.t - 0.25::DOUBLE - 1e-9::DOUBLE), 0.0::DOUBLE) AS previous_start FROM p JOIN cues_c c USING (attempt_id) GROUP BY 1, 2",
    "j15_source_fallback": "WITH a AS (SELECT DISTINCT attempt_id, song_id, audio_source FROM attempts) SELECT song_id, coalesce(min(attempt_id) FILTER (audio_source = 'vocals'), min(attempt_id) FILTER (coalesce(audio_source, '') <> 'vocals')) AS attempt_id FROM a GROUP BY 1",
    "j16_dimension_join": "WITH a AS (SELECT DISTINCT attempt_id, song_id, audio_source, language_code FROM attempts), dim(audio_source, label, kind) AS (VALUES ('vocals', 'Vocals', 'stem'), ('mix', 'Full mix', 'mix')) SELECT coalesce(label, upper(a.audio_source[1]) || lower(a.audio_source[2:]), 'Unknown') AS label, coalesce(kind, 'other') AS kind, count(*) AS attempts FROM a LEFT JOIN dim USING (audio_source) GROUP BY 1, 2",
    "j17_unused_tags": "WITH used AS (SELECT lower(title_tag) AS tag FROM media_metadata UNION SELECT lower(artist_tag) FROM media_metadata), t AS (SELECT DISTINCT song_id, lower(unnest(ignored_tags)) AS tag FROM media_metadata) SELECT tag, count(DISTINCT song_id) AS songs FROM t WHERE tag NOT IN (SELECT tag FROM used WHERE tag IS NOT NULL) GROUP BY 1",
    "j18_missing_references": "WITH s AS (SELECT DISTINCT song_id FROM media_metadata), u AS (SELECT 'attempts' AS source, song_id FROM attempts UNION SELECT 'embedded_lyrics', song_id FROM embedded_lyrics UNION SELECT 'notes', song_id FROM notes) SELECT source, count(*) AS songs, count(*) FILTER (s.song_id IS NULL) AS missing FROM u LEFT JOIN s ON s.song_id = u.song_id GROUP BY 1",
    "j20_first_near": f'WITH {_NP(10.0)}, l AS (SELECT run_id, max("end" - start) AS longest FROM notes_c GROUP BY 1) SELECT p.run_id, p.t, min(n.start) FILTER (n.start > p.t - l.longest - 0.5::DOUBLE - 1e-9::DOUBLE) AS first_start FROM p JOIN l USING (run_id) JOIN notes_c n USING (run_id) GROUP BY 1, 2',
}
