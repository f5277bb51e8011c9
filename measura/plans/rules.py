"""Stateful and checking rules over whole tables: loops, mixers, clocks, sections, offsets, reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions import text as X
from measura.functions.music import TUNINGS
from measura.operators import interval_joins as J
from measura.operators import notes as N
from measura.operators.intervals import prefix_max
from measura.operators.sequences import edit_loops
from measura.plans.joins import _CP, _cue_probes
from measura.plans.notes import TUNING_SQL
from measura.session import table
from measura.sources.bind import CUES_SQL, NOTES_SQL, load_cues, load_notes, load_words

# Kinds of sections, keys of title tags, the shortest and the usual loop, the life of an impact and how many show.
KINDS = ("intro", "verse", "chorus", "bridge", "interlude", "outro", "section")
LEAST_LOOP, USUAL_LOOP, RING, LONGEST_FLASH, MOST_IMPACTS = 0.25, 1.0, 0.18, 0.6, 12


def s7_watermark(spark, d, delay_s: int = 3600):
    """Events of each type by whether they are late: behind the latest time that arrived so far (in the order of ids) less an hour."""
    e = table(spark, d, "events").select("event_type", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"))
    late = F.col("us") < F.col("reach") - delay_s * 1_000_000
    return prefix_max(e, ["event_type"], ["event_id"], "us", "reach").groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(late).alias("late"))


def s10_drift(spark, d):
    """Two clocks of a word, when it was measured and where it stands in its cue: a seek beyond 0.12 s of drift, else a rate within 1.5 %."""
    cues = load_cues(spark, d).select("cue_id", F.col("start").alias("a"), F.col("end").alias("b"), F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    drift = F.col("start") - (F.col("a") + (F.col("b") - F.col("a")) * F.col("word_ix") / F.col("n"))
    w = load_words(spark, d).join(cues, "cue_id").withColumn("drift", drift)
    seek = F.abs("drift") > 0.12
    rate = F.greatest(F.lit(0.985), F.least(F.lit(1.015), 1 - F.col("drift") * 0.18))
    return w.groupBy("attempt_id").agg(F.count_if(seek).alias("seeks"), F.count_if(~seek).alias("held"), F.round(F.avg(F.when(~seek, rate)), 6).alias("mean_rate"))


def s12_loop_edits(spark, d):
    """The loop of each player after their edits, in order: a click sets its start, a view its end, a signup clears it.

    A start without an end behind it gets one second; a loop that isn't 0.25 s long is refused and off.
    """
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "signup")).select("user_id", "ts", "event_id", "event_type", "value")
    rows = e.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "event_type", "value")
    return rows.mapInArrow(edit_loops(LEAST_LOOP, USUAL_LOOP), "user_id long, loop_start double, loop_end double, active boolean, refused long")


def s13_edge_events(spark, d, tick: float = 0.5):
    """Impacts that show at each tick: an onset lives from its start for 0.18 s, or as long as it sounds but 0.6 s at most; twelve at most show."""
    until = F.greatest(F.col("start") + RING, F.least("end", F.col("start") + LONGEST_FLASH))
    c = load_cues(spark, d).select("attempt_id", F.ceil(F.col("start") / tick).alias("a"), (F.ceil(until / tick) - 1).alias("b")).where("a <= b")
    return c.select("attempt_id", F.explode(F.sequence("a", "b")).alias("tick")).groupBy("attempt_id", "tick").agg(F.least(F.count("*"), F.lit(MOST_IMPACTS)).alias("shown"))


def s15_mute_solo(spark, d):
    """Tracks (event types) of each mixer (user) that are heard: events whose k divides by 4 toggle mute, those with remainder 1 toggle solo.

    If any track plays solo only such tracks are heard; mute wins over all.
    """
    k = F.get_json_object("props", "$.k").cast("long") % 4
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.count_if(k == 0) % 2 == 1).alias("muted"), (F.count_if(k == 1) % 2 == 1).alias("solo"))
    any_solo = F.bool_or("solo").over(W.partitionBy("user_id"))  # the tracks of one mixer
    return t.select("user_id", "event_type", (~F.col("muted") & (~any_solo | F.col("solo"))).alias("audible"))


def s11_group_barrier(spark, d, lead: float = 20.0):
    """How far the stems (event types) of each player have come together: the least of their latest positions; stems that hold the rest back."""
    latest = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("at"))
    return latest.groupBy("user_id").agg(F.min("at").alias("ready_until"), F.count("*").alias("stems"), (F.max("at") - F.min("at") > lead).alias("paused"))


def s5_block_mix(spark, d, block: int = 16, ramp: int = 16, share: float = 0.75):
    """Frames of each block (sixteen vectors) mixed from its tracks (labels), each by its gain; a track that wasn't in the block before
    is faded in over sixteen frames, and the loop ends at an exact frame (three quarters of all)."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / block).alias("block"), "label", "embedding")
    present = e.select((F.col("block") + 1).alias("block"), "label").distinct().withColumn("steady", F.lit(True))
    last = e.agg(F.floor((F.max("block") + 1) * F.max(F.size("embedding")) * share).alias("frames"))  # one row
    s = e.join(present, ["block", "label"], "left").select("block", "label", F.coalesce("steady", F.lit(False)).alias("steady"), F.size("embedding").alias("size"), F.posexplode("embedding").alias("frame", "sample"))
    s = s.join(F.broadcast(last), F.col("block") * F.col("size") + F.col("frame") < F.col("frames"))
    gain = (1 - F.col("label") * 0.05) * F.when(F.col("steady"), 1.0).otherwise(F.least(F.lit(1.0), (F.col("frame") + 1) / ramp))
    return s.groupBy("block", "frame").agg(F.round(F.sum(F.col("sample").cast("double") * gain), 4).alias("mix"))


def b13_sections(spark, d):
    """Sections of each sheet, by its marked lines: whether there are 1 to 200, the first at the top, with ids of their own and known kinds."""
    sheets = table(spark, d, "documents").where("doc_kind = 'sheet'").select("doc_id", F.split("text", "\r?\n").alias("lines"))
    s = sheets.select("doc_id", F.posexplode("lines").alias("at", "line")).withColumn("label", F.regexp_extract("line", r"^\[([A-Za-z][^\[\]]*)\][ \t]*$", 1)).where("label <> ''")
    s = s.withColumns({"id": F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "-"), "kind": F.lower(F.regexp_extract("label", r"^([A-Za-z]+)", 1))})
    checks = s.groupBy("doc_id").agg(
        F.count("*").alias("sections"), (F.count("*") <= 200).alias("few"), (F.min("at") == 0).alias("from_top"), (F.count_distinct("id") == F.count("*")).alias("own_ids"),
        F.bool_and(F.col("id").rlike("^[a-z][a-z0-9-]{0,79}$")).alias("sound_ids"), F.bool_and(F.col("kind").isin(*KINDS)).alias("known_kinds"),
    )
    return checks.withColumn("valid", F.col("few") & F.col("from_top") & F.col("own_ids") & F.col("sound_ids") & F.col("known_kinds"))


def b17_offsets(spark, d):
    """Words listed for each cue as offsets into the words of its text: whether first + count stays within their number."""
    w = load_words(spark, d).groupBy("cue_id").agg(F.min("word_ix").alias("first"), F.count("*").alias("listed"))
    total = load_cues(spark, d).select("cue_id", F.size(F.split(F.trim("text"), r"\s+")).alias("total"))
    return w.join(total, "cue_id").select("cue_id", "first", "listed", "total", (F.col("first") + F.col("listed") <= F.col("total")).alias("sound"))


def b19_valid_utf8(spark, d, size: int = 8):
    """Titles cut to their first eight bytes: whether what is left is UTF-8, which it isn't where a character is cut in two."""
    t = table(spark, d, "media_metadata").where("title IS NOT NULL").select("song_id", "title").dropDuplicates(["song_id"])
    return t.select("song_id", F.is_valid_utf8(F.substring(F.col("title").cast("binary"), 1, size).cast("string")).alias("valid"))


def a25_stored_reports(spark, d):
    """Alignment reports as they are stored (JSON): given whole where every part is in range, else not at all."""
    a = table(spark, d, "attempts").select("attempt_id", "language_confidence").dropDuplicates(["attempt_id"])
    stored = F.to_json(F.struct(F.col("language_confidence").alias("matched_fraction"), (F.col("attempt_id") % 9 - 1).alias("interpolated_words"), (F.col("attempt_id") % 5).cast("double").alias("mean_displacement"), F.lit(True).alias("usable")))
    read = X.stored_report(stored)
    return a.select("attempt_id", read["matched_fraction"].alias("matched_fraction"), read["interpolated_words"].alias("interpolated_words"))


def a28_metadata(spark, d):
    """Title and artist of each song with where they come from: a tag that names them, else the file's name; ignored tags counted."""
    m = table(spark, d, "media_metadata").select("song_id", "title", "artist", "container", "title_tag", "artist_tag", "ignored_tags").dropDuplicates(["song_id"])
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    tag = lambda c: F.lower(F.coalesce(some(c), F.lit("")))
    stem = some(F.regexp_replace(F.regexp_replace("title", "_+", " "), r"^[0-9]+ ", ""))
    named = tag("title_tag") != ""
    title = F.coalesce(F.when(named, some("title")), stem, F.concat(F.lit("song-"), F.col("song_id").cast("string")))
    source = F.when(named & some("title").isNotNull(), tag("title_tag")).when(stem.isNotNull(), "stem").otherwise("made")
    artist = F.coalesce(F.when(tag("artist_tag") != "", some("artist")), F.lit("unknown"))
    return m.select("song_id", title.alias("title"), source.alias("title_from"), artist.alias("artist"), F.lower("container").alias("container"), F.coalesce(F.size(F.array_distinct("ignored_tags")), F.lit(0)).alias("ignored"))


def a29_json_objects(spark, d, limit: int = 9):
    """JSON documents of events that are read: objects of so many bytes at most."""
    e = table(spark, d, "events").select("event_id", "props")
    read = (F.octet_length("props") <= limit) & F.from_json("props", "map<string,string>").isNotNull()
    return e.select("event_id", F.coalesce(read, F.lit(False)).alias("accepted"))


def a36_artifacts(spark, d):
    """Whether the path that a project names for its audio stays inside the project: relative, without empty, ``.`` or ``..`` parts."""
    m = table(spark, d, "media_metadata").select("song_id", "container").distinct()
    n = F.col("song_id") % 6
    head = F.when(n == 0, "/").when(n == 1, "../").when(n == 2, "audio/./").when(n == 3, "audio//").otherwise("audio/")
    path = F.concat(head, F.col("song_id").cast("string"), F.lit("."), F.lower(F.coalesce("container", F.lit("bin"))))
    return m.select("song_id", path.alias("path")).withColumn("inside", X.stays_inside(F.col("path")))


def j19_closed_cue_at(spark, d):
    """The cue at each probe as a browser shows it: closed at its end, and without an end for 0.18 s."""
    t = table(spark, d, "raw_cues").where("start_s IS NOT NULL AND NOT isnan(start_s) AND start_s >= 0").select("cue_id", "attempt_id", F.col("start_s").alias("start"), F.coalesce(F.nanvl("end_s", F.lit(None).cast("double")), F.col("start_s") + RING).alias("end")).dropDuplicates(["cue_id"])
    hit = J.as_of(_cue_probes(spark, d), t, "attempt_id", "t", "start", "cue_id", ["cue_id", "end"])
    return hit.select("attempt_id", "t", F.when(F.col("t") <= F.col("end"), F.col("cue_id")).alias("cue_id"))


def h20_player_strings(spark, d):
    """Positions of each note with the string's number as players count them: from the highest string, 1, to the lowest, 6."""
    return N.positions(load_notes(spark, d)).select("note_id", "string", (F.lit(len(TUNINGS["standard"])) - F.col("string")).alias("player_string"))


QUERIES = {f.__name__: f for f in (h20_player_strings, s5_block_mix, s7_watermark, s10_drift, s11_group_barrier, s12_loop_edits, s13_edge_events, s15_mute_solo, b13_sections, b17_offsets, b19_valid_utf8, a25_stored_reports, a28_metadata, a29_json_objects, a36_artifacts, j19_closed_cue_at)}

_WORDS = """words_c AS (SELECT DISTINCT word_id, cue_id, attempt_id, word_ix, start_s AS start FROM lyric_words WHERE isfinite(start_s) AND isfinite(end_s) AND start_s >= 0 AND end_s >= start_s)"""
ORACLES = {
    "h20_player_strings": f"WITH {NOTES_SQL}, {TUNING_SQL} SELECT note_id, string, 6 - string AS player_string FROM notes_c JOIN tuning ON pitch - open BETWEEN 0 AND 20",
    "s7_watermark": "WITH e AS (SELECT event_type, epoch_us(ts) < max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 3600000000 AS late FROM events) SELECT event_type, count(*) AS events, count(*) FILTER (late) AS late FROM e GROUP BY 1",
    "s10_drift": rf"""WITH {CUES_SQL}, {_WORDS}, n AS (SELECT w.attempt_id, w.start - (c.start + (c."end" - c.start) * w.word_ix / len(string_split_regex(trim(c.text), '\s+'))) AS drift FROM words_c w JOIN cues_c c USING (cue_id))
SELECT attempt_id, count(*) FILTER (abs(drift) > 0.12::DOUBLE) AS seeks, count(*) FILTER (abs(drift) <= 0.12::DOUBLE) AS held, round(avg(greatest(0.985::DOUBLE, least(1.015::DOUBLE, 1 - drift * 0.18::DOUBLE))) FILTER (abs(drift) <= 0.12::DOUBLE), 6) AS mean_rate FROM n GROUP BY 1""",
    "s11_group_barrier": "WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) SELECT user_id, min(v) AS ready_until, count(*) AS stems, max(v) - min(v) > 20 AS paused FROM l GROUP BY 1",
    "s12_loop_edits": """WITH RECURSIVE e AS (SELECT user_id, event_type AS w, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'view', 'signup')),
f AS (SELECT DISTINCT user_id, 0 AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, false AS active, 0 AS refused FROM e
 UNION ALL SELECT e.user_id, f.n + 1, CASE w WHEN 'click' THEN v WHEN 'signup' THEN 0 ELSE a END, CASE w WHEN 'view' THEN v WHEN 'signup' THEN 0 ELSE CASE WHEN b <= v THEN v + 1 ELSE b END END,
 CASE w WHEN 'click' THEN (CASE WHEN b <= v THEN v + 1 ELSE b END) - v >= 0.25 WHEN 'view' THEN v - a >= 0.25 ELSE false END,
 refused + CASE w WHEN 'click' THEN ((CASE WHEN b <= v THEN v + 1 ELSE b END) - v < 0.25)::INT WHEN 'view' THEN (v - a < 0.25)::INT ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, a AS loop_start, b AS loop_end, active, refused::BIGINT AS refused FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
    "s13_edge_events": f"""WITH {CUES_SQL}, i AS (SELECT attempt_id, CAST(ceil(start / 0.5::DOUBLE) AS BIGINT) AS a, CAST(ceil(greatest(start + 0.18::DOUBLE, least("end", start + 0.6::DOUBLE)) / 0.5::DOUBLE) AS BIGINT) - 1 AS b FROM cues_c), t AS (SELECT attempt_id, unnest(generate_series(a, b)) AS tick FROM i WHERE a <= b) SELECT attempt_id, tick, least(count(*), 12) AS shown FROM t GROUP BY 1, 2""",
    "s15_mute_solo": "WITH t AS (SELECT user_id, event_type, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 0) % 2 = 1 AS muted, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 1) % 2 = 1 AS solo FROM events GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN muted THEN false WHEN bool_or(solo) OVER (PARTITION BY user_id) THEN solo ELSE true END AS audible FROM t",
    "s5_block_mix": """WITH e AS (SELECT vec_id // 16 AS block, label, embedding FROM embeddings), l AS (SELECT floor((max(block) + 1) * max(len(embedding)) * 0.75::DOUBLE) AS frames FROM e), p AS (SELECT DISTINCT block + 1 AS block, label FROM e),
s AS (SELECT e.block, e.label, p.block IS NOT NULL AS steady, len(embedding) AS size, generate_subscripts(embedding, 1)::INT - 1 AS frame, unnest(embedding) AS sample FROM e LEFT JOIN p ON p.block = e.block AND p.label = e.label)
SELECT block, frame, round(sum(sample::DOUBLE * ((1 - label * 0.05::DOUBLE) * CASE WHEN steady THEN 1 ELSE least(1::DOUBLE, (frame + 1) / 16::DOUBLE) END)), 4) AS mix FROM s, l WHERE block * size + frame < frames GROUP BY 1, 2""",
    "b13_sections": r"""WITH t AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS lines FROM documents WHERE doc_kind = 'sheet' AND text IS NOT NULL), x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS ix FROM t),
s AS (SELECT doc_id, ix, regexp_extract(line, '^\[([A-Za-z][^\[\]]*)\][ \t]*$', 1) AS label FROM x), k AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g') AS id, lower(regexp_extract(label, '^([A-Za-z]+)', 1)) AS kind FROM s WHERE label <> ''),
c AS (SELECT doc_id, count(*) AS sections, count(*) <= 200 AS few, min(ix) = 0 AS from_top, count(DISTINCT id) = count(*) AS own_ids, bool_and(regexp_full_match(id, '[a-z][a-z0-9-]{0,79}')) AS sound_ids, bool_and(kind IN ('intro', 'verse', 'chorus', 'bridge', 'interlude', 'outro', 'section')) AS known_kinds FROM k GROUP BY 1)
SELECT *, few AND from_top AND own_ids AND sound_ids AND known_kinds AS valid FROM c""",
    "b17_offsets": rf"""WITH {CUES_SQL}, {_WORDS}, w AS (SELECT cue_id, min(word_ix) AS first, count(*) AS listed FROM words_c GROUP BY 1) SELECT cue_id, first, listed, len(string_split_regex(trim(text), '\s+'))::INT AS total, first + listed <= len(string_split_regex(trim(text), '\s+')) AS sound FROM w JOIN cues_c USING (cue_id)""",
    "b19_valid_utf8": "WITH t AS (SELECT song_id, any_value(title) AS title FROM media_metadata WHERE title IS NOT NULL GROUP BY 1) SELECT song_id, strlen(title) <= 8 OR list_contains(list_transform(range(0, 9), lambda k: strlen(array_to_string(list_slice(string_split(title, ''), 1, k), ''))), 8) AS valid FROM t",
    "a25_stored_reports": "WITH a AS (SELECT DISTINCT attempt_id, language_confidence AS c FROM attempts), v AS (SELECT *, coalesce(c BETWEEN 0 AND 1 AND NOT isnan(c), false) AND attempt_id % 9 > 0 AS fine FROM a) SELECT attempt_id, CASE WHEN fine THEN c END AS matched_fraction, CASE WHEN fine THEN attempt_id % 9 - 1 END AS interpolated_words FROM v",
    "a28_metadata": """WITH m AS (SELECT DISTINCT song_id, title, artist, container, title_tag, artist_tag, ignored_tags FROM media_metadata), x AS (SELECT *, lower(coalesce(trim(title_tag), '')) AS tt, lower(coalesce(trim(artist_tag), '')) AS ag, nullif(trim(title), '') AS t, nullif(trim(regexp_replace(regexp_replace(title, '_+', ' ', 'g'), '^[0-9]+ ', '')), '') AS stem FROM m)
SELECT song_id, coalesce(CASE WHEN tt <> '' THEN t END, stem, 'song-' || song_id) AS title, CASE WHEN tt <> '' AND t IS NOT NULL THEN tt WHEN stem IS NOT NULL THEN 'stem' ELSE 'made' END AS title_from, coalesce(CASE WHEN ag <> '' THEN nullif(trim(artist), '') END, 'unknown') AS artist, lower(container) AS container, coalesce(len(list_distinct(ignored_tags)), 0)::INT AS ignored FROM x""",
    "a29_json_objects": "SELECT event_id, coalesce(strlen(props) <= 9 AND json_valid(props) AND json_type(props) = 'OBJECT', false) AS accepted FROM events",
    "a36_artifacts": "WITH m AS (SELECT DISTINCT song_id, container FROM media_metadata) SELECT song_id, CASE song_id % 6 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'audio/./' WHEN 3 THEN 'audio//' ELSE 'audio/' END || song_id || '.' || lower(coalesce(container, 'bin')) AS path, song_id % 6 >= 4 AS inside FROM m",
    "j19_closed_cue_at": f"""WITH {_CP}, o AS (SELECT DISTINCT cue_id, attempt_id, start_s AS start, CASE WHEN end_s IS NULL OR isnan(end_s) THEN start_s + 0.18::DOUBLE ELSE end_s END AS fin FROM raw_cues WHERE start_s IS NOT NULL AND NOT isnan(start_s) AND start_s >= 0), one AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY attempt_id, start ORDER BY cue_id DESC) = 1)
SELECT p.attempt_id, p.t, CASE WHEN p.t <= one.fin THEN one.cue_id END AS cue_id FROM p ASOF LEFT JOIN one ON one.attempt_id = p.attempt_id AND one.start <= p.t""",
}
