"""Queries over the catalogue: stage ledger, ranking and choice, set operations, sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions import text as X
from measura.operators import ledger as L
from measura.operators import notes as N
from measura.plans.notes import NOTES_SQL, SELECTED_SQL, TUNING_SQL, selected
from measura.plans.text import _ISLRC, _LY
from measura.operators.rangescan import numbered
from measura.session import table
from measura.sources import timed_text as P
from measura.sources.bind import CUES_SQL, load_cues, load_notes

RECORD = "stage string, status string, sha256 string, size bigint, seconds double"


def stage_records(spark, d):
    """(doc_id, line_ix, stage, status, sha256, size, seconds, place) of the JSON lines of run logs."""
    logs = P.lines_of(table(spark, d, "documents").where("doc_kind = 'runlog'"), "doc_id", "text").where("trim(line) <> ''")
    r = logs.select("doc_id", "line_ix", F.from_json("line", RECORD).alias("r")).select("doc_id", "line_ix", "r.*")
    return r.where("stage IS NOT NULL").withColumn("place", L.stage_place(F.col("stage")))


def a31_json_members(spark, d):
    """Member k of the JSON of each event, by event type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


def a34_stage_scan(spark, d):
    return stage_records(spark, d).drop("place")


def b18_valid_records(spark, d):
    return stage_records(spark, d).groupBy("doc_id").agg(F.count_if(L.valid_record()).alias("valid"), F.count_if(~L.valid_record()).alias("invalid"))


def b15_project_ids(spark, d):
    """Ids made of titles, and whether they follow the grammar of project ids."""
    m = table(spark, d, "media_metadata").select("song_id", "title").dropDuplicates(["song_id"])
    pid = F.concat(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"), F.col("song_id").cast("string"))
    return m.select("song_id", pid.alias("project_id"), pid.rlike("^[a-z0-9][a-z0-9-]{7,63}$").alias("valid"))


def b11_tunings(spark, d):
    """Whether six distinct ascending pitches within 0..127 make a tuning, for the lowest pitches of each run."""
    low = load_notes(spark, d).groupBy("run_id").agg(F.slice(F.array_sort(F.collect_set("pitch")), 1, 6).alias("t"))
    ok = (F.size("t") == 6) & F.forall("t", lambda p: p.between(0, 127)) & (F.array_distinct("t") == F.array_sort("t"))
    return low.select("run_id", F.array_join(F.transform("t", lambda p: p.cast("string")), " ").alias("tuning"), ok.alias("valid"))


def s1_stage_ledger(spark, d):
    """Stages of each log that still have to run: those without a done entry of their fingerprint."""
    r = stage_records(spark, d).withColumn("fingerprint", L.fingerprint("stage", "sha256"))
    return L.to_run(r.select("doc_id", "stage", "fingerprint"), r, "doc_id").select("doc_id", "stage")


def s2_invalidation(spark, d):
    one = stage_records(spark, d).groupBy("doc_id", "place", "stage").agg(F.max_by("status", "line_ix").alias("status"))
    return L.invalidated(one, "doc_id").select("doc_id", "stage", "status", "effective")


def s3_subsumption(spark, d):
    """For the source each attempt asked for, the best source already decoded for its song."""
    a = table(spark, d, "attempts").select("attempt_id", "song_id", "audio_source").dropDuplicates(["attempt_id"])
    ranks = [("mix", 1), ("vocals", 2)]
    return L.subsumed(a.select("song_id", F.col("audio_source").alias("model")).distinct(), a.select("song_id", F.lit("mix").alias("model")).distinct(), "song_id", ranks)


def a35_library(spark, d):
    """Songs in the order of the library: the latest scan first, then the id."""
    m = table(spark, d, "media_metadata").groupBy("song_id").agg(F.max("scanned_at").alias("at"))
    return numbered(m.select("song_id", "at"), [F.desc("at"), F.asc("song_id")], "song_id", "place")


def a6_durations(spark, d):
    """Songs by what their duration allows: missing, not positive, too long or fine."""
    m = table(spark, d, "media_metadata").select("song_id", "duration").dropDuplicates(["song_id"])
    verdict = F.when(F.col("duration").isNull() | F.isnan("duration"), "missing").when(F.col("duration") <= 0, "not positive").when(F.col("duration") > 300, "too long").otherwise("fine")
    return m.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("songs"))


def _sheets(spark, d):
    t = table(spark, d, "embedded_lyrics").select("lyrics_id", "song_id", "tag", "origin", "language_code", "text").dropDuplicates(["lyrics_id"]).where(F.col("text").rlike(r"\S"))
    return t.withColumns({"is_lrc": P.looks_like_lrc(F.col("text")), "lang": X.tag_language(F.col("tag"))})


def f4_best_sheet(spark, d, wanted: str = "en"):
    """The best embedded sheet of each song: timed first, then the wanted language, then the longest, then the first."""
    t = _sheets(spark, d)
    w = W.partitionBy("song_id").orderBy(F.desc("is_lrc"), F.desc(F.coalesce(X.language_base(F.col("lang")) == wanted, F.lit(False))), F.desc(F.length("text")), "lyrics_id")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("song_id", "lyrics_id", "is_lrc")


def f5_sidecar_rank(spark, d, wanted: str = "es"):
    """Rank of each sheet as if it lay beside its media: no language 0, the wanted language 1, another 2."""
    t = _sheets(spark, d)
    rank = F.when(F.col("lang") == "unknown", 0).when(X.language_base(F.col("lang")) == wanted, 1).otherwise(2)
    return t.groupBy("song_id").agg(F.min_by("lyrics_id", F.struct(rank, "lyrics_id")).alias("lyrics_id"), F.min(rank).alias("rank"))


def f6_caption_rank(spark, d, wanted: str = "en"):
    """Attempts of a song ranked like caption tracks: not translated, wanted language, human before automatic, name."""
    a = table(spark, d, "attempts").select("attempt_id", "song_id", "language_code", "language_from").dropDuplicates(["attempt_id"])
    base = X.language_base(F.coalesce("language_code", F.lit("")))
    lang = F.when(base == wanted, 0).when(base == "", 1).otherwise(2)
    kind = F.when(F.col("language_from") == "requested", 0).when(F.col("language_from") == "model", 1).otherwise(2)
    w = W.partitionBy("song_id").orderBy(lang, kind, "attempt_id")
    return a.select("attempt_id", "song_id", F.row_number().over(w).cast("long").alias("rank"))


def f7_lyric_plan(spark, d):
    """Where the lyrics of each song come from: a timed sheet, any sheet, an attempt, or nothing."""
    songs = table(spark, d, "media_metadata").select("song_id").distinct()
    t = _sheets(spark, d).groupBy("song_id").agg(F.bool_or("is_lrc").alias("timed"))
    a = table(spark, d, "attempts").select("song_id", F.lit(True).alias("tried")).distinct()
    j = songs.join(t, "song_id", "left").join(a, "song_id", "left")
    plan = F.when(F.col("timed"), "sheet-timed").when(F.col("timed").isNotNull(), "sheet").when(F.col("tried"), "attempt").otherwise("none")
    return j.groupBy(plan.alias("plan")).agg(F.count("*").alias("songs"))


def f8_first_ready(spark, d):
    """The first provider, in order of preference, that has notes for each song."""
    order = ("basic-pitch", "onsets-frames", "mt3")
    place = F.coalesce(F.array_position(F.array(*(F.lit(o) for o in order)), F.col("provider")), F.lit(0)).cast("int")
    n = table(spark, d, "notes").select("song_id", "provider").distinct()
    return n.groupBy("song_id").agg(F.min_by("provider", F.struct(F.when(place == 0, 99).otherwise(place), "provider")).alias("provider"))


def g2_ignored_union(spark, d):
    """Up to 32 sorted names of ignored tags and of the tags in use, for each song."""
    m = table(spark, d, "media_metadata").select("song_id", "ignored_tags", "title_tag", "artist_tag").dropDuplicates(["song_id"])
    both = F.array_union(F.coalesce("ignored_tags", F.array().cast("array<string>")), F.array_compact(F.array(F.lower("title_tag"), F.lower("artist_tag"))))
    return m.select("song_id", F.array_join(F.slice(F.array_sort(both), 1, 32), " ").alias("tags"))


def g3_shared_pitches(spark, d):
    """Whether each onset group shares a pitch with the group before it in its run."""
    g = selected(spark, d).groupBy("run_id", "anchor").agg(F.collect_set("pitch").alias("p"))
    before = F.lag("p").over(W.partitionBy("run_id").orderBy("anchor"))
    return g.select("run_id", "anchor", F.coalesce(F.arrays_overlap("p", before), F.lit(False)).alias("shares"))


def g4_new_pitches(spark, d):
    """Pitches of each onset group that the group before it doesn't have."""
    g = selected(spark, d).groupBy("run_id", "anchor").agg(F.collect_set("pitch").alias("p"))
    before = F.lag("p").over(W.partitionBy("run_id").orderBy("anchor"))
    return g.select("run_id", "anchor", F.size(F.array_except("p", F.coalesce(before, F.array().cast("array<int>")))).alias("new"))


def g6_partition_check(spark, d):
    """Whether the onset groups of a run hold each selected note exactly once."""
    s = selected(spark, d)
    return s.groupBy("run_id").agg((F.count("*") == F.count_distinct("anchor", "pitch")).alias("exact"), F.count("*").alias("notes"))


def g7_language_set(spark, d):
    """Languages that attempts of a song declare, and the first of them."""
    a = table(spark, d, "attempts").select("attempt_id", "song_id", "language_code").dropDuplicates(["attempt_id"]).withColumn("b", X.language_base(F.coalesce("language_code", F.lit("")))).where("b <> ''")
    return a.groupBy("song_id").agg(F.array_join(F.array_sort(F.collect_set("b")), " ").alias("languages"), F.min_by("b", "attempt_id").alias("first"))


def k1_canonical_json(spark, d):
    """Canonical JSON of each stage record and its digest."""
    r = stage_records(spark, d)
    text = F.to_json(F.struct("sha256", "size", "stage", "status"))
    return r.select("doc_id", "line_ix", text.alias("json"), F.sha2(F.concat(text, F.lit("\n")), 256).alias("digest"))


def k4_ascii_tab(spark, d):
    """Tablature as text: systems of twelve onset groups, a line for each string, high to low."""
    s = selected(spark, d)
    ev = s.select("run_id", "anchor").distinct().withColumn("n", F.row_number().over(W.partitionBy("run_id").orderBy("anchor")) - 1)
    low = N.positions(s).groupBy("run_id", "anchor", "pitch").agg(F.min(F.struct("fret", "string")).alias("p")).groupBy("run_id", "anchor", F.col("p.string").alias("string")).agg(F.min("p.fret").alias("fret"))
    strings = F.explode(F.sequence(F.lit(0), F.lit(5)))
    cells = ev.select("run_id", "anchor", "n", strings.alias("string")).join(low, ["run_id", "anchor", "string"], "left")
    cell = F.lpad(F.coalesce(F.col("fret").cast("string"), F.lit("")), 2, "-")
    g = cells.groupBy("run_id", F.floor(F.col("n") / 12).alias("system"), "string").agg(F.array_sort(F.collect_list(F.struct("n", cell.alias("c")))).alias("cells"))
    return g.select("run_id", "system", "string", F.concat(F.lit("|"), F.array_join(F.transform("cells", lambda x: x["c"]), "-"), F.lit("|")).alias("line"))


def b12_tab_check(spark, d):
    """Tab positions that don't give back their pitch, or share a string within an event: none."""
    s = N.positions(selected(spark, d))
    return s.groupBy("run_id").agg(F.count_if(F.element_at(F.array(*(F.lit(t) for t in (40, 45, 50, 55, 59, 64))), F.col("string") + 1) + F.col("fret") != F.col("pitch")).alias("wrong"), F.count("*").alias("positions"))


def show_summary(spark, d):
    """What ``show`` prints of a song: its sheets, attempts and notes."""
    songs = table(spark, d, "media_metadata").select("song_id").distinct()
    for name, key, label in (("embedded_lyrics", "lyrics_id", "sheets"), ("attempts", "attempt_id", "attempts"), ("notes", "note_id", "notes")):
        songs = songs.join(table(spark, d, name).groupBy("song_id").agg(F.count_distinct(key).alias(label)), "song_id", "left")
    return songs.fillna(0)


QUERIES = {f.__name__: f for f in (a6_durations, a31_json_members, a34_stage_scan, a35_library, b11_tunings, b12_tab_check, b15_project_ids, b18_valid_records, f4_best_sheet, f5_sidecar_rank, f6_caption_rank, f7_lyric_plan, f8_first_ready, g2_ignored_union, g3_shared_pitches, g4_new_pitches, g6_partition_check, g7_language_set, k1_canonical_json, k4_ascii_tab, s1_stage_ledger, s2_invalidation, s3_subsumption)}
QUERIES["show_summary"] = show_summary

_REC = r"""rl AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1)::INT - 1 AS line_ix FROM documents WHERE doc_kind = 'runlog' AND text IS NOT NULL),
rec AS (SELECT doc_id, line_ix, json_extract_string(line, '$.stage') AS stage, json_extract_string(line, '$.status') AS status, json_extract_string(line, '$.sha256') AS sha256, CAST(json_extract(line, '$.size') AS BIGINT) AS size, CAST(json_extract(line, '$.seconds') AS DOUBLE) AS seconds, list_position(['acquire','normalise','separate','lyrics','transcribe','tablature','export'], json_extract_string(line, '$.stage'))::INT - 1 AS place FROM rl WHERE trim(line) <> '' AND json_valid(line))"""
_VALID = "coalesce(place IS NOT NULL AND status IN ('pending','running','done','error') AND regexp_full_match(sha256, '[0-9a-f]{64}') AND size >= 0, false)"
_SH = f"{_LY}, sh AS (SELECT *, {_ISLRC('text')} AS is_lrc, regexp_extract(lower(trim(tag)), '^(?:unsyncedlyrics|syncedlyrics|lyrics)[-_]([a-z]{{2,3}}(?:-(?:[a-z]{{4}}|[a-z]{{2}}|[0-9]{{3}}))?)$', 1) AS tl FROM ly WHERE regexp_matches(text, '\\S')), al(three, two) AS (VALUES " + ", ".join(f"('{three}', '{two}')" for two, threes in X.LANGUAGE_ALIASES.items() for three in threes.split()) + "), sb AS (SELECT sh.*, coalesce(two, left(tl, 3)) AS base FROM sh LEFT JOIN al ON three = regexp_extract(tl, '^([a-z]{2,3})', 1))"
_AB = "att AS (SELECT DISTINCT attempt_id, song_id, language_code, language_from, audio_source FROM attempts), al(three, two) AS (VALUES " + ", ".join(f"('{three}', '{two}')" for two, threes in X.LANGUAGE_ALIASES.items() for three in threes.split()) + "), ab AS (SELECT x.*, coalesce(two, x.b0, '') AS base FROM (SELECT *, regexp_extract(lower(trim(coalesce(language_code, ''))), '^([a-z]{2,3})(?:[-_].*)?$', 1) AS b0 FROM att) x LEFT JOIN al ON three = b0)"
_SETS = f"{SELECTED_SQL}, gs AS (SELECT run_id, anchor, list_sort(list(DISTINCT pitch)) AS p FROM chosen GROUP BY 1, 2), gl AS (SELECT *, lag(p) OVER (PARTITION BY run_id ORDER BY anchor) AS before FROM gs)"
ORACLES = {
    "a6_durations": "WITH m AS (SELECT DISTINCT song_id, duration FROM media_metadata) SELECT CASE WHEN duration IS NULL OR isnan(duration) THEN 'missing' WHEN duration <= 0 THEN 'not positive' WHEN duration > 300 THEN 'too long' ELSE 'fine' END AS verdict, count(*) AS songs FROM m GROUP BY 1",
    "a31_json_members": "SELECT event_type, count(CAST(json_extract(props, '$.k') AS BIGINT)) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY 1",
    "a34_stage_scan": f"WITH {_REC} SELECT doc_id, line_ix, stage, status, sha256, size, seconds FROM rec WHERE stage IS NOT NULL",
    "a35_library": "WITH m AS (SELECT song_id, max(scanned_at) AS seen FROM media_metadata GROUP BY 1) SELECT song_id, row_number() OVER (ORDER BY seen DESC NULLS LAST, song_id) AS place FROM m",
    "b11_tunings": f"WITH {NOTES_SQL}, t AS (SELECT run_id, list_sort(list(DISTINCT pitch))[1:6] AS t FROM notes_c GROUP BY 1) SELECT run_id, array_to_string(t, ' ') AS tuning, len(t) = 6 AS valid FROM t",
    "b12_tab_check": f"WITH RECURSIVE {SELECTED_SQL}, {TUNING_SQL} SELECT run_id, count(*) FILTER (open + (pitch - open) <> pitch) AS wrong, count(*) AS positions FROM chosen JOIN tuning ON pitch - open BETWEEN 0 AND 20 GROUP BY 1",
    "b15_project_ids": "WITH m AS (SELECT DISTINCT song_id, title FROM media_metadata), p AS (SELECT song_id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g') || '-' || song_id AS project_id FROM m) SELECT *, regexp_full_match(project_id, '[a-z0-9][a-z0-9-]{7,63}') AS valid FROM p",
    "b18_valid_records": f"WITH {_REC} SELECT doc_id, count(*) FILTER ({_VALID}) AS valid, count(*) FILTER (NOT {_VALID}) AS invalid FROM rec WHERE stage IS NOT NULL GROUP BY 1",
    "f4_best_sheet": f"WITH {_SH} SELECT song_id, lyrics_id, is_lrc FROM sb QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY is_lrc DESC, coalesce(base = 'en', false) DESC, length(text) DESC, lyrics_id) = 1",
    "f5_sidecar_rank": f"WITH {_SH}, r AS (SELECT *, CASE WHEN tl = '' THEN 0 WHEN base = 'es' THEN 1 ELSE 2 END AS rnk FROM sb) SELECT song_id, arg_min(lyrics_id, (rnk, lyrics_id)) AS lyrics_id, min(rnk) AS rank FROM r GROUP BY 1",
    "f6_caption_rank": f"WITH {_AB} SELECT attempt_id, song_id, row_number() OVER (PARTITION BY song_id ORDER BY CASE WHEN base = 'en' THEN 0 WHEN base = '' THEN 1 ELSE 2 END, CASE language_from WHEN 'requested' THEN 0 WHEN 'model' THEN 1 ELSE 2 END, attempt_id) AS rank FROM ab",
    "f7_lyric_plan": f"WITH {_SH}, t AS (SELECT song_id, bool_or(is_lrc) AS timed FROM sb GROUP BY 1), a AS (SELECT DISTINCT song_id FROM attempts), j AS (SELECT s.song_id, t.timed, a.song_id IS NOT NULL AS tried FROM (SELECT DISTINCT song_id FROM media_metadata) s LEFT JOIN t USING (song_id) LEFT JOIN a ON a.song_id = s.song_id) SELECT CASE WHEN timed THEN 'sheet-timed' WHEN timed IS NOT NULL THEN 'sheet' WHEN tried THEN 'attempt' ELSE 'none' END AS plan, count(*) AS songs FROM j GROUP BY 1",
    "f8_first_ready": "WITH n AS (SELECT DISTINCT song_id, provider FROM notes) SELECT song_id, arg_min(provider, (coalesce(list_position(['basic-pitch', 'onsets-frames', 'mt3'], provider), 99), provider)) AS provider FROM n GROUP BY 1",
    "g2_ignored_union": "WITH m AS (SELECT DISTINCT song_id, ignored_tags, lower(title_tag) AS a, lower(artist_tag) AS b FROM media_metadata) SELECT song_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(ignored_tags, []), [a, b]), lambda x: x IS NOT NULL)))[1:32], ' ') AS tags FROM m",
    "g3_shared_pitches": f"WITH RECURSIVE {_SETS} SELECT run_id, anchor, coalesce(list_has_any(p, before), false) AS shares FROM gl",
    "g4_new_pitches": f"WITH RECURSIVE {_SETS} SELECT run_id, anchor, len(list_filter(p, lambda x: before IS NULL OR NOT list_contains(before, x)))::INT AS new FROM gl",
    "g6_partition_check": f"WITH RECURSIVE {SELECTED_SQL} SELECT run_id, count(*) = count(DISTINCT (anchor, pitch)) AS exact, count(*) AS notes FROM chosen GROUP BY 1",
    "g7_language_set": f"WITH {_AB} SELECT song_id, array_to_string(list_sort(list(DISTINCT base)), ' ') AS languages, arg_min(base, attempt_id) AS first FROM ab WHERE base <> '' GROUP BY 1",
    "k1_canonical_json": f"""WITH {_REC}, j AS (SELECT doc_id, line_ix, '{{"sha256":"' || sha256 || '","size":' || size || ',"stage":"' || stage || '","status":"' || status || '"}}' AS json FROM rec WHERE stage IS NOT NULL) SELECT *, sha256(json || chr(10)) AS digest FROM j""",
    "k4_ascii_tab": f"""WITH RECURSIVE {SELECTED_SQL}, {TUNING_SQL}, ev AS (SELECT run_id, anchor, row_number() OVER (PARTITION BY run_id ORDER BY anchor) - 1 AS n FROM (SELECT DISTINCT run_id, anchor FROM chosen)),
po AS (SELECT run_id, anchor, pitch, string, pitch - open AS fret FROM chosen JOIN tuning ON pitch - open BETWEEN 0 AND 20 QUALIFY row_number() OVER (PARTITION BY run_id, anchor, pitch ORDER BY pitch - open, string) = 1),
lo AS (SELECT run_id, anchor, string, min(fret) AS fret FROM po GROUP BY 1, 2, 3),
ce AS (SELECT e.run_id, e.n, t.string, coalesce(lpad(l.fret::VARCHAR, 2, '-'), '--') AS c FROM ev e CROSS JOIN tuning t LEFT JOIN lo l ON l.run_id = e.run_id AND l.anchor = e.anchor AND l.string = t.string)
SELECT run_id, CAST(n // 12 AS BIGINT) AS system, string, '|' || string_agg(c, '-' ORDER BY n) || '|' AS line FROM ce GROUP BY 1, 2, 3""",
    "s1_stage_ledger": f"WITH {_REC} SELECT doc_id, stage FROM rec r WHERE stage IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec q WHERE q.doc_id = r.doc_id AND q.stage = r.stage AND q.sha256 = r.sha256 AND q.status = 'done')",
    "s2_invalidation": f"WITH {_REC}, o AS (SELECT doc_id, place, stage, arg_max(status, line_ix) AS status FROM rec WHERE stage IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT *, max((status <> 'done')::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broken FROM o) SELECT doc_id, stage, status, CASE WHEN broken = 1 THEN 'pending' ELSE status END AS effective FROM b",
    "s3_subsumption": "WITH a AS (SELECT DISTINCT song_id, audio_source FROM attempts), s AS (SELECT DISTINCT song_id FROM a) SELECT song_id, 'mix' AS model, CASE WHEN bool_or(coalesce(audio_source, '') = 'vocals') THEN 'vocals' WHEN bool_or(coalesce(audio_source, '') = 'mix') THEN 'mix' END AS served_by FROM a GROUP BY 1",
    "show_summary": "WITH s AS (SELECT DISTINCT song_id FROM media_metadata) SELECT song_id, coalesce((SELECT count(DISTINCT lyrics_id) FROM embedded_lyrics e WHERE e.song_id = s.song_id), 0) AS sheets, coalesce((SELECT count(DISTINCT attempt_id) FROM attempts a WHERE a.song_id = s.song_id), 0) AS attempts, coalesce((SELECT count(DISTINCT note_id) FROM notes n WHERE n.song_id = s.song_id), 0) AS notes FROM s",
}
