"""Queries over texts: parsers, text rules, geometry of the neck."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measura.functions import music as M
from measura.functions import text as X
from measura.operators.sequences import weight
from measura.session import table
from measura.sources import timed_text as P


def _lyrics(spark, d):
    return table(spark, d, "embedded_lyrics").select("lyrics_id", "song_id", "tag", "origin", "language_code", "text").dropDuplicates(["lyrics_id"])


def _docs(spark, d, kind):
    return table(spark, d, "documents").where(F.col("doc_kind") == kind).select("doc_id", "text")


def _media(spark, d):
    return table(spark, d, "media_metadata").select("song_id", "title", "artist", "duration", "container", "title_tag", "artist_tag").dropDuplicates(["song_id"])


def _cues(spark, d):
    return table(spark, d, "raw_cues").select("cue_id", "attempt_id", "text").where("text IS NOT NULL").dropDuplicates(["cue_id"])


def a17_bounded_text(spark, d, limit: int = 4_194_304):
    t = _lyrics(spark, d)
    return t.select("lyrics_id", F.octet_length("text").alias("bytes"), F.coalesce((F.octet_length("text") <= limit) & ~F.contains(F.col("text"), F.lit("\u0000")), F.lit(False)).alias("accepted"))


def a18_document_formats(spark, d):
    """The parser each document goes to: by kind, LRC by its stamps, else plain."""
    t = table(spark, d, "documents").select("doc_id", "doc_kind", "text")
    fmt = F.when(F.col("doc_kind") == "runlog", "json").when(F.col("text").startswith("WEBVTT") | F.col("text").contains("-->"), "vtt").when(P.looks_like_lrc(F.col("text")), "lrc").when(~F.col("text").rlike(r"\S"), None).otherwise("plain")
    return t.select("doc_id", F.when(F.col("text").isNotNull(), fmt).alias("format"))


def a19_vtt_cues(spark, d):
    return P.parse_blocks(_docs(spark, d, "vtt"), "doc_id", "text").drop("block_ix")


def a20_lrc_cues(spark, d):
    return P.parse_lrc(_docs(spark, d, "lrc"), "doc_id", "text")


def a22_looks_like_lrc(spark, d):
    return _lyrics(spark, d).where("text IS NOT NULL").select("lyrics_id", P.looks_like_lrc(F.col("text")).alias("is_lrc"))


def a23_plain_cues(spark, d):
    return P.plain_cues(_docs(spark, d, "sheet"), "doc_id", "text", F.lit(180.0))


def a18_loaded_documents(spark, d):
    """Documents of cues loaded by the parser of their kind: how many cues each gives, from when to when; one that gives none is refused."""
    docs = table(spark, d, "documents").where(F.col("doc_kind").isin("vtt", "lrc", "sheet")).select("doc_id", "doc_kind")
    cues = [q(spark, d).select("doc_id", "start", "end") for q in (a19_vtt_cues, a20_lrc_cues, a23_plain_cues)]
    spans = cues[0].unionByName(cues[1]).unionByName(cues[2]).groupBy("doc_id").agg(F.count("*").alias("cues"), F.round(F.min("start"), 3).alias("first"), F.round(F.max("end"), 3).alias("last"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "doc_kind", F.coalesce("cues", F.lit(0)).alias("cues"), "first", "last", F.col("cues").isNull().alias("refused"))


def a26_embedded_cues(spark, d):
    """Cues of each embedded sheet: by its stamps, else a line each."""
    t = _lyrics(spark, d).where("trim(text) <> ''").withColumn("is_lrc", P.looks_like_lrc(F.col("text")))
    timed = P.parse_lrc(t.where("is_lrc"), "lyrics_id", "text").groupBy("lyrics_id").agg(F.count("*").alias("cues"), F.lit("lrc").alias("format"))
    plain = P.lines_of(t.where("NOT is_lrc"), "lyrics_id", "text").where(X.plain_text(F.col("line")) != "").groupBy("lyrics_id").agg(F.count("*").alias("cues"), F.lit("plain").alias("format"))
    return timed.unionByName(plain)


def b9_marker_lines(spark, d):
    t = P.lines_of(_lyrics(spark, d), "lyrics_id", "text").withColumn("line", F.trim("line"))
    return t.groupBy("lyrics_id").agg(F.count_if(X.is_marker(F.col("line"))).alias("markers"))


def b6_phantom_phrases(spark, d):
    """Cues that are empty of words or stock phrases of a decoder."""
    bare = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    stock = ("thanks for watching", "thank you for watching", "please subscribe to my channel", "subscribe to my channel", "don t forget to subscribe", "like and subscribe", "please like and subscribe", "ご視聴ありがとうございました", "продолжение следует")
    return _cues(spark, d).select("cue_id", ((bare == "") | bare.isin(*stock) | bare.contains("amara org")).alias("phantom"))


def a8_digests(spark, d):
    return _lyrics(spark, d).where("text IS NOT NULL").select("lyrics_id", F.sha2("text", 256).alias("sha256"))


def h1_display_line(spark, d):
    return _media(spark, d).where("title IS NOT NULL").select("song_id", X.display_line(F.col("title"), 24).alias("line"))


def h3_plain_text(spark, d):
    return _cues(spark, d).select("cue_id", X.plain_text(F.concat(F.lit("<i>"), "text", F.lit("</i> &amp; &lt;b&gt;"))).alias("plain"))


def h4_tokens(spark, d):
    return _cues(spark, d).select("cue_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


def _pairs(spark, d):
    """Each cue with text and the text of the cue before it, in any script."""
    w = W.partitionBy("attempt_id").orderBy("cue_id")
    c = _cues(spark, d).withColumn("before", F.lag("text").over(w))
    return c.where("before IS NOT NULL")


def h6_levenshtein(spark, d):
    return _pairs(spark, d).select("cue_id", F.levenshtein("before", "text").alias("distance"))


def h7_similarity(spark, d):
    return _pairs(spark, d).select("cue_id", F.round(X.similarity(F.col("before"), F.col("text")), 6).alias("similarity"))


def h8_letter_mask(spark, d):
    return _pairs(spark, d).select("cue_id", X.letter_mask(F.col("text")).alias("mask"))


def h9_pair_score(spark, d):
    return _pairs(spark, d).select("cue_id", F.round(X.pair_score(X.similarity(F.col("before"), F.col("text"))), 6).alias("score"))


def h10_line_rules(spark, d):
    """Whether a line ends a sentence, continues the line before or extends it, and the time its words take."""
    p = _pairs(spark, d)
    return p.select("cue_id", (~F.rtrim("before").rlike(r"[.!?…]$")).alias("open"), (F.col("text").rlike(r"^\p{Ll}") | F.rtrim("before").rlike("[,\\-–—…;:]$")).alias("continues"), F.col("text").startswith(F.concat("before", F.lit(" "))).alias("extends"), F.round(F.lit(0.35) + F.size(F.split(F.trim("text"), r"\s+")) * F.lit(0.55), 6).alias("sung"))


def h11_language_base(spark, d):
    return _lyrics(spark, d).select("lyrics_id", X.language_base(F.col("language_code")).alias("base"))


def h12_tag_keys(spark, d):
    return _lyrics(spark, d).select("lyrics_id", X.tag_family(F.col("tag")).alias("family"), X.tag_language(F.col("tag")).alias("language"))


def h13_receipts(spark, d):
    """A receipt of each attempt as ``model;k=v;...`` and its fields read back."""
    a = table(spark, d, "attempts").select("attempt_id", "audio_source", "language_code", "language_from").dropDuplicates(["attempt_id"])
    text = F.concat_ws(";", F.lit("decoder:base"), F.concat(F.lit("audio="), "audio_source"), F.concat(F.lit("lang="), F.coalesce("language_code", F.lit(""))), F.concat(F.lit("lang_from="), "language_from"))
    fields = F.str_to_map(F.regexp_replace("receipt", "^[^;]*;", ""), F.lit(";"), F.lit("="))
    return a.withColumn("receipt", text).select("attempt_id", "receipt", F.regexp_extract("receipt", "^decoder:([^;]*)", 1).alias("model"), F.try_element_at(fields, F.lit("audio")).alias("audio"), F.try_element_at(fields, F.lit("lang_from")).alias("lang_from"))


def h14_redaction(spark, d):
    said = F.concat(F.lit("failed at https://host.example/x?id="), F.col("song_id").cast("string"), F.lit(" in /home/user"), F.col("song_id").cast("string"), F.lit("/media: "), F.coalesce("title", F.lit("?")))
    return _media(spark, d).select("song_id", X.redacted(said).alias("message"))


def h18_aligned_source(spark, d):
    return _lyrics(spark, d).select("lyrics_id", F.regexp_replace(F.concat("origin", F.lit("-estimated")), "-estimated$", "-aligned").alias("source"))


def h19_size_labels(spark, d):
    n = F.when(F.col("song_id") % 3 == 0, F.col("song_id") * 1024).when(F.col("song_id") % 3 == 1, F.col("song_id") * 1048576).otherwise(F.col("song_id"))
    return _media(spark, d).select("song_id", X.size_label(n).alias("label"))


def h21_clock_seconds(spark, d):
    stamps = P.lines_of(_docs(spark, d, "lrc"), "doc_id", "text").select("doc_id", "line_ix", F.regexp_extract("line", P.STAMP, 1).alias("clock")).where("clock <> ''")
    return stamps.select("doc_id", "line_ix", X.clock_seconds(F.col("clock")).alias("seconds"))


def h22_clock_text(spark, d):
    return table(spark, d, "notes").where("start_s IS NOT NULL AND NOT isnan(start_s)").select("note_id", "start_s").dropDuplicates(["note_id"]).select("note_id", X.clock_text(F.col("start_s")).alias("clock"))


def h24_utc_text(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


def h32_weights(spark, d):
    return _cues(spark, d).select("cue_id", weight(F.col("text")).alias("weight"))


def h33_decimals(spark, d):
    """Every decimal in a sheet, with its place."""
    found = _lyrics(spark, d).where("text IS NOT NULL").select("lyrics_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\d+\.\d+"), F.lit(0))).alias("place", "s"))
    return found.select("lyrics_id", "place", F.col("s").cast("double").alias("value"))


def _frets(spark):
    return spark.range(0, 25).select(F.col("id").cast("int").alias("fret"))


def h25_fret_geometry(spark, d):
    f = F.col("fret")
    return _frets(spark).select("fret", F.round(M.fret_position(f), 9).alias("position"), F.round(M.cell_centre(f), 9).alias("centre"), F.round(M.fret_position(f) / (1 - 2 ** (-20 / 12)), 9).alias("shown"))


def h16_roman(spark, d):
    return spark.range(0, 31).select(F.col("id").cast("int").alias("fret")).select("fret", M.roman(F.col("fret")).alias("numeral"))


def h28_inlays(spark, d):
    return _frets(spark).select("fret", M.inlay(F.col("fret")).alias("dots"))


def h29_string_widths(spark, d):
    g = F.element_at(F.array(*(F.lit(x) for x in M.GAUGES)), F.col("string") + 1)
    ratio = F.sqrt(g / F.lit(0.010))
    return spark.range(0, 6).select(F.col("id").cast("int").alias("string")).select("string", F.round(ratio, 6).alias("ratio"), F.greatest(F.lit(1), F.round(ratio * 2).cast("int")).alias("width"))


def h15_tuning_labels(spark, d):
    """Label and player's number (h20) of each open string; the highest is written in lower case."""
    s = F.explode(F.array(*(F.struct(F.lit(n).alias("tuning"), F.lit(i).alias("string"), F.lit(p).alias("pitch")) for n, t in M.TUNINGS.items() for i, p in enumerate(t)))).alias("s")
    name = M.class_name(F.col("s.pitch"))
    return spark.range(1).select(s).select("s.tuning", "s.string", F.when(F.col("s.string") == 5, F.lower(name)).otherwise(name).alias("label"), (6 - F.col("s.string")).alias("player_string"))


def h30_display_points(spark, d):
    """Row and point of every position of the neck, seen from the player's side."""
    p = _frets(spark).crossJoin(F.broadcast(spark.range(0, 6).select(F.col("id").cast("int").alias("string"))))  # 25 frets by 6 strings
    row = 5 - F.col("string")
    x = F.when(F.col("fret") == 0, F.lit(0.0)).otherwise(M.cell_centre(F.col("fret")) / (1 - 2 ** (-24 / 12)))
    return p.select("string", "fret", row.alias("row"), F.round(x, 9).alias("x"), F.round((row + 0.5) / 6, 9).alias("y"))


def h31_note_life(spark, d):
    """Visible life of a note, at least 0.22 s, and its level half a second after the onset."""
    n = table(spark, d, "notes").where("start_s IS NOT NULL AND NOT isnan(start_s) AND end_s > start_s AND end_s < 1e300").select("note_id", "start_s", "end_s").dropDuplicates(["note_id"])
    life = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.22))
    return n.select("note_id", F.round(life, 6).alias("life"), F.round(F.greatest(F.lit(0.0), 1 - F.lit(0.5) / life), 6).alias("level"))


def _given(spark, d):
    """Sources as people give them, made from the catalogue."""
    i = F.col("song_id")
    s = i.cast("string")
    value = (
        F.when(i % 8 == 0, F.concat(F.lit("https://youtu.be/"), s)).when(i % 8 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), s, F.lit("&list=PL"), s)).when(i % 8 == 2, F.concat(F.lit("https://www.youtube.com/playlist?list=PL"), s))
        .when(i % 8 == 3, F.concat(F.lit("http://youtu.be/"), s)).when(i % 8 == 4, F.concat(F.lit("https://user:pw@youtube.com/watch?v="), s)).when(i % 8 == 5, F.concat(F.lit("https://youtube.com:8443/watch?v="), s))
        .when(i % 8 == 6, F.concat(F.lit("file:///music/"), s, F.lit(".mp3"))).otherwise(F.concat(F.lit("/music/"), s, F.lit(".flac")))
    )
    return _media(spark, d).select("song_id", value.alias("value"))


def a1_parse_source(spark, d):
    return _given(spark, d).select("song_id", X.source_kind(F.col("value")).alias("kind"))


def a2_validate_url(spark, d):
    return _given(spark, d).where(X.source_kind(F.col("value")) == "url").select("song_id", X.url_verdict(F.col("value")).alias("verdict"))


def a5_file_sizes(spark, d):
    unit = F.element_at(F.array(*(F.lit(u) for u in ("", "k", "M", "g", "T", "x"))), (F.col("song_id") % 6 + 1).cast("int"))
    return _media(spark, d).select("song_id", X.file_size(F.concat(F.col("song_id").cast("string"), unit)).alias("bytes"))


QUERIES = {f.__name__: f for f in (a1_parse_source, a2_validate_url, a5_file_sizes, a8_digests, a17_bounded_text, a18_document_formats, a18_loaded_documents, a19_vtt_cues, a20_lrc_cues, a22_looks_like_lrc, a23_plain_cues, a26_embedded_cues, b6_phantom_phrases, b9_marker_lines, h1_display_line, h3_plain_text, h4_tokens, h6_levenshtein, h7_similarity, h8_letter_mask, h9_pair_score, h10_line_rules, h11_language_base, h12_tag_keys, h13_receipts, h14_redaction, h15_tuning_labels, h16_roman, h18_aligned_source, h19_size_labels, h21_clock_seconds, h22_clock_text, h24_utc_text, h25_fret_geometry, h28_inlays, h29_string_widths, h30_display_points, h31_note_life, h32_weights, h33_decimals)}

_LY = "ly AS (SELECT DISTINCT lyrics_id, song_id, tag, origin, language_code, text FROM embedded_lyrics)"
_ME = "me AS (SELECT song_id, any_value(title) AS title, any_value(artist) AS artist FROM media_metadata GROUP BY 1)"
_CU = "cu AS (SELECT DISTINCT cue_id, attempt_id, text FROM raw_cues WHERE text IS NOT NULL)"
_PA = _CU + r", pa AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY attempt_id ORDER BY cue_id) AS before FROM cu) WHERE before IS NOT NULL)"
_LINES = lambda src, key: rf"lines AS (SELECT {key}, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 AS line_ix FROM {src} WHERE text IS NOT NULL)"
_PLAIN = lambda c: rf"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"
_ISLRC = lambda c: rf"(len(list_filter(string_split_regex({c}, '\r?\n'), lambda x: trim(x) <> '')) >= 2 AND len(list_filter(string_split_regex({c}, '\r?\n'), lambda x: trim(x) <> '' AND regexp_matches(x, '^\s*\[\d{{1,3}}:\d{{1,2}}(\.\d{{1,3}})?\]'))) >= 2 AND len(list_filter(string_split_regex({c}, '\r?\n'), lambda x: trim(x) <> '' AND regexp_matches(x, '^\s*\[\d{{1,3}}:\d{{1,2}}(\.\d{{1,3}})?\]'))) * 2 >= len(list_filter(string_split_regex({c}, '\r?\n'), lambda x: trim(x) <> '')))"
_LRC = rf"""st AS (SELECT key, line_ix, regexp_extract_all(line, '\[(\d{{1,3}}:\d{{1,2}}(?:\.\d{{1,3}})?)\]', 1) AS stamps, {_PLAIN(r"regexp_replace(line, '\[(\d{1,3}:\d{1,2}(?:\.\d{1,3})?)\]', '', 'g')")} AS text FROM lines),
ex AS (SELECT key, line_ix, text, unnest(stamps) AS stamp, generate_subscripts(stamps, 1) AS stamp_ix FROM st WHERE len(stamps) > 0 AND text <> ''),
se AS (SELECT *, CAST(split_part(stamp, ':', 1) AS DOUBLE) * 60 + CAST(split_part(stamp, ':', 2) AS DOUBLE) AS start FROM ex),
lrc AS (SELECT key, start, greatest(start + 0.05::DOUBLE, coalesce(lead(start) OVER (PARTITION BY key ORDER BY start, text, line_ix, stamp_ix), least(600.0::DOUBLE, start + 5))) AS "end", text FROM se)"""
_ALIAS = ", ".join(f"('{three}', '{two}')" for two, threes in X.LANGUAGE_ALIASES.items() for three in threes.split())
_GIVEN = f"""{_ME}, gv AS (SELECT song_id, CASE song_id % 8 WHEN 0 THEN 'https://youtu.be/' || song_id WHEN 1 THEN 'https://www.youtube.com/watch?v=' || song_id || '&list=PL' || song_id WHEN 2 THEN 'https://www.youtube.com/playlist?list=PL' || song_id WHEN 3 THEN 'http://youtu.be/' || song_id WHEN 4 THEN 'https://user:pw@youtube.com/watch?v=' || song_id WHEN 5 THEN 'https://youtube.com:8443/watch?v=' || song_id WHEN 6 THEN 'file:///music/' || song_id || '.mp3' ELSE '/music/' || song_id || '.flac' END AS value FROM me)"""
_ROMAN = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI','XXII','XXIII','XXIV']"
_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
ORACLES = {
    "a1_parse_source": f"WITH {_GIVEN} SELECT song_id, CASE WHEN starts_with(value, 'https://') THEN 'url' WHEN starts_with(value, 'file://') THEN 'file-url' WHEN contains(value, '://') THEN 'refused' ELSE 'path' END AS kind FROM gv",
    "a2_validate_url": f"WITH {_GIVEN} SELECT song_id, CASE song_id % 8 WHEN 2 THEN 'playlist' WHEN 4 THEN 'credentials' WHEN 5 THEN 'port' ELSE 'ok' END AS verdict FROM gv WHERE starts_with(value, 'https://')",
    "a5_file_sizes": f"WITH {_ME}, v AS (SELECT song_id, song_id * CASE song_id % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1099511627776 END AS b FROM me) SELECT song_id, CASE WHEN b > 0 AND b <= 1125899906842624 THEN CAST(b AS BIGINT) END AS bytes FROM v",
    "a8_digests": f"WITH {_LY} SELECT lyrics_id, sha256(text) AS sha256 FROM ly WHERE text IS NOT NULL",
    "a17_bounded_text": f"WITH {_LY} SELECT lyrics_id, strlen(text)::INT AS bytes, coalesce(strlen(text) <= 4194304 AND NOT contains(text, chr(0)), false) AS accepted FROM ly",
    "a18_document_formats": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_kind = 'runlog' THEN 'json' WHEN starts_with(text, 'WEBVTT') OR contains(text, '-->') THEN 'vtt' WHEN {_ISLRC('text')} THEN 'lrc' WHEN NOT regexp_matches(text, '\\S') THEN NULL ELSE 'plain' END AS format FROM documents",
    "a19_vtt_cues": rf"""WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n[ \t]*\r?\n')) AS block FROM documents WHERE doc_kind = 'vtt' AND text IS NOT NULL),
t AS (SELECT doc_id, block, regexp_extract(block, '((?:\d{{1,3}}:)?\d{{1,3}}:\d{{1,2}}[.,]\d{{1,3}})[ \t]+-->', 1) AS a, regexp_extract(block, '-->[ \t]+((?:\d{{1,3}}:)?\d{{1,3}}:\d{{1,2}}[.,]\d{{1,3}})', 1) AS z FROM b WHERE contains(block, '-->')),
u AS (SELECT doc_id, list_reverse(string_split(replace(a, ',', '.'), ':')) AS p, list_reverse(string_split(replace(z, ',', '.'), ':')) AS q, {_PLAIN(r"regexp_replace(block, '(?s)^.*?-->[^\n]*(?:\n|$)', '')")} AS text FROM t WHERE a <> '' AND z <> '')
SELECT doc_id, coalesce(CAST(p[3] AS DOUBLE), 0) * 3600 + CAST(p[2] AS DOUBLE) * 60 + CAST(p[1] AS DOUBLE) AS start, coalesce(CAST(q[3] AS DOUBLE), 0) * 3600 + CAST(q[2] AS DOUBLE) * 60 + CAST(q[1] AS DOUBLE) AS "end", text FROM u WHERE text <> ''""",
    "a20_lrc_cues": f"WITH src AS (SELECT doc_id AS key, text FROM documents WHERE doc_kind = 'lrc'), {_LINES('src', 'key')}, {_LRC} SELECT key AS doc_id, start, \"end\", text FROM lrc",
    "a22_looks_like_lrc": f"WITH {_LY} SELECT lyrics_id, {_ISLRC('text')} AS is_lrc FROM ly WHERE text IS NOT NULL",
    "a23_plain_cues": f"WITH src AS (SELECT doc_id, text FROM documents WHERE doc_kind = 'sheet'), {_LINES('src', 'doc_id')}, p AS (SELECT doc_id, line_ix, {_PLAIN('line')} AS text FROM lines), n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, text FROM p WHERE text <> '') SELECT doc_id, i AS line_ix, round(i * 180.0::DOUBLE / n, 9) AS start, round(least(180.0::DOUBLE, (i + 1) * 180.0::DOUBLE / n), 9) AS \"end\", text FROM n",
    "a26_embedded_cues": f"WITH {_LY}, t AS (SELECT *, {_ISLRC('text')} AS is_lrc FROM ly WHERE trim(text) <> ''), src AS (SELECT lyrics_id AS key, text FROM t), {_LINES('src', 'key')}, {_LRC} SELECT key AS lyrics_id, count(*) AS cues, 'lrc' AS format FROM lrc WHERE key IN (SELECT lyrics_id FROM t WHERE is_lrc) GROUP BY 1 UNION ALL SELECT key, count(*), 'plain' FROM lines WHERE key IN (SELECT lyrics_id FROM t WHERE NOT is_lrc) AND {_PLAIN('line')} <> '' GROUP BY 1",
    "b6_phantom_phrases": f"WITH {_CU}, f AS (SELECT cue_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS bare FROM cu) SELECT cue_id, bare = '' OR bare IN ('thanks for watching', 'thank you for watching', 'please subscribe to my channel', 'subscribe to my channel', 'don t forget to subscribe', 'like and subscribe', 'please like and subscribe', 'ご視聴ありがとうございました', 'продолжение следует') OR contains(bare, 'amara org') AS phantom FROM f",
    "b9_marker_lines": rf"WITH {_LY}, {_LINES('ly', 'lyrics_id')} SELECT lyrics_id, count(*) FILTER (regexp_matches(trim(line), '^\[[^\[\]]*\]$') OR regexp_matches(lower(trim(line)), '^\(\s*(bridge|breakdown|chorus|coda|hook|instrumental|interlude|intro|outro|prechorus|refrain|repeat|solo|spoken|vamp|verse)([^\p{{L}}\p{{N}}''()][^()]*)?\)$')) AS markers FROM lines GROUP BY 1",
    "h1_display_line": f"WITH {_ME} SELECT song_id, left(trim(regexp_replace(title, '[\\p{{C}}\\p{{Z}}]+', ' ', 'g')), 24) AS line FROM me WHERE title IS NOT NULL",
    "h3_plain_text": f"WITH {_CU}, x AS (SELECT cue_id, '<i>' || text || '</i> &amp; &lt;b&gt;' AS t FROM cu) SELECT cue_id, {_PLAIN('t')} AS plain FROM x",
    "h8_letter_mask": f"WITH {_PA}, c AS (SELECT cue_id, unnest(string_split(text, '')) AS ch FROM pa) SELECT cue_id, bit_or(CASE WHEN ch = '' THEN 0 ELSE 1::BIGINT << (ascii(ch) % 63) END) AS mask FROM c GROUP BY 1",
    "h10_line_rules": rf"WITH {_PA} SELECT cue_id, NOT regexp_matches(rtrim(before), '[.!?…]$') AS open, regexp_matches(text, '^\p{{Ll}}') OR regexp_matches(rtrim(before), '[,\-–—…;:]$') AS continues, starts_with(text, before || ' ') AS extends, round(0.35::DOUBLE + len(string_split_regex(trim(text), '\s+')) * 0.55::DOUBLE, 6) AS sung FROM pa",
    "h11_language_base": f"WITH {_LY}, alias(three, two) AS (VALUES {_ALIAS}), b AS (SELECT lyrics_id, regexp_extract(lower(trim(language_code)), '^([a-z]{{2,3}})(?:[-_].*)?$', 1) AS base FROM ly) SELECT lyrics_id, coalesce(two, base, '') AS base FROM b LEFT JOIN alias ON three = base",
    "h12_tag_keys": f"WITH {_LY}, k AS (SELECT lyrics_id, lower(trim(tag)) AS k FROM ly) SELECT lyrics_id, regexp_extract(k, '^(unsyncedlyrics|syncedlyrics|lyrics)(?:[-_].*)?$', 1) AS family, CASE WHEN regexp_extract(k, '^(?:unsyncedlyrics|syncedlyrics|lyrics)[-_]([a-z]{{2,3}}(?:-(?:[a-z]{{4}}|[a-z]{{2}}|[0-9]{{3}}))?)$', 1) = '' THEN 'unknown' ELSE regexp_extract(k, '^(?:unsyncedlyrics|syncedlyrics|lyrics)[-_]([a-z]{{2,3}}(?:-(?:[a-z]{{4}}|[a-z]{{2}}|[0-9]{{3}}))?)$', 1) END AS language FROM k",
    "h13_receipts": "SELECT DISTINCT attempt_id, concat_ws(';', 'decoder:base', 'audio=' || audio_source, 'lang=' || coalesce(language_code, ''), 'lang_from=' || language_from) AS receipt, 'base' AS model, audio_source AS audio, language_from AS lang_from FROM attempts",
    "h14_redaction": f"WITH {_ME} SELECT song_id, left(trim(regexp_replace('failed at <redacted-url> in <home>/media: ' || coalesce(title, '?'), '[\\p{{C}}\\p{{Z}}]+', ' ', 'g')), 500) AS message FROM me",
    "h15_tuning_labels": "WITH t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS tuning, {i} AS string, {p} AS pitch" for n, t in M.TUNINGS.items() for i, p in enumerate(t)) + f") SELECT tuning, string, CASE WHEN string = 5 THEN lower({_NAMES}[pitch % 12 + 1]) ELSE {_NAMES}[pitch % 12 + 1] END AS label, 6 - string AS player_string FROM t",
    "h16_roman": f"SELECT i::INT AS fret, CASE WHEN i BETWEEN 1 AND 24 THEN {_ROMAN}[i] ELSE i::VARCHAR END AS numeral FROM range(0, 31) r(i)",
    "h18_aligned_source": f"WITH {_LY} SELECT lyrics_id, origin || '-aligned' AS source FROM ly",
    "h19_size_labels": f"WITH {_ME}, n AS (SELECT song_id, CASE song_id % 3 WHEN 0 THEN song_id * 1024 WHEN 1 THEN song_id * 1048576 ELSE song_id END AS n FROM me) SELECT song_id, CASE WHEN n >= 1073741824 AND n % 1073741824 = 0 THEN (n // 1073741824) || 'G' WHEN n >= 1048576 AND n % 1048576 = 0 THEN (n // 1048576) || 'M' WHEN n >= 1024 AND n % 1024 = 0 THEN (n // 1024) || 'K' ELSE n || ' bytes' END AS label FROM n",
    "h21_clock_seconds": f"WITH src AS (SELECT doc_id, text FROM documents WHERE doc_kind = 'lrc'), {_LINES('src', 'doc_id')}, c AS (SELECT doc_id, line_ix, regexp_extract(line, '\\[(\\d{{1,3}}:\\d{{1,2}}(?:\\.\\d{{1,3}})?)\\]', 1) AS c FROM lines) SELECT doc_id, line_ix::INT AS line_ix, CAST(split_part(c, ':', 1) AS DOUBLE) * 60 + CAST(split_part(c, ':', 2) AS DOUBLE) AS seconds FROM c WHERE c <> ''",
    "h22_clock_text": "WITH n AS (SELECT DISTINCT note_id, TRY_CAST(round(greatest(start_s, 0) * 1000) AS BIGINT) AS ms FROM notes WHERE isfinite(start_s)) SELECT note_id, CASE WHEN ms // 60000 < 10 THEN '0' ELSE '' END || (ms // 60000) || ':' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock FROM n",
    "h24_utc_text": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events",
    "h25_fret_geometry": "SELECT f::INT AS fret, round(1 - 2.0::DOUBLE ** (-f / 12), 9) AS position, round(CASE WHEN f = 0 THEN 0 ELSE ((1 - 2.0::DOUBLE ** (-(f - 1) / 12)) + (1 - 2.0::DOUBLE ** (-f / 12))) / 2 END, 9) AS centre, round((1 - 2.0::DOUBLE ** (-f / 12)) / (1 - 2.0::DOUBLE ** (-20.0::DOUBLE / 12)), 9) AS shown FROM range(0, 25) r(f)",
    "h28_inlays": "SELECT f::INT AS fret, CASE WHEN f IN (12, 24) THEN 2 WHEN f IN (3, 5, 7, 9, 15, 17, 19, 21) THEN 1 ELSE 0 END AS dots FROM range(0, 25) r(f)",
    "h29_string_widths": "WITH g(string, gauge) AS (VALUES (0, 0.046::DOUBLE), (1, 0.036), (2, 0.026), (3, 0.017), (4, 0.013), (5, 0.010)) SELECT string, round(sqrt(gauge / 0.010::DOUBLE), 6) AS ratio, greatest(1, round(sqrt(gauge / 0.010::DOUBLE) * 2)::INT) AS width FROM g",
    "h30_display_points": "SELECT s::INT AS string, f::INT AS fret, (5 - s)::INT AS row, round(CASE WHEN f = 0 THEN 0 ELSE ((1 - 2.0::DOUBLE ** (-(f - 1) / 12)) + (1 - 2.0::DOUBLE ** (-f / 12))) / 2 / 0.75 END, 9) AS x, round((5 - s + 0.5::DOUBLE) / 6, 9) AS y FROM range(0, 25) a(f), range(0, 6) b(s)",
    "h31_note_life": "WITH n AS (SELECT DISTINCT note_id, greatest(end_s - start_s, 0.22::DOUBLE) AS life FROM notes WHERE NOT isnan(start_s) AND end_s > start_s AND end_s < 1e300) SELECT note_id, round(life, 6) AS life, round(greatest(0.0::DOUBLE, 1 - 0.5::DOUBLE / life), 6) AS level FROM n",
    "h32_weights": f"WITH {_CU} SELECT cue_id, greatest(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')), 1)::INT AS weight FROM cu",
    "h33_decimals": f"WITH {_LY}, s AS (SELECT lyrics_id, regexp_extract_all(text, '\\d+\\.\\d+') AS found FROM ly), u AS (SELECT lyrics_id, unnest(found) AS s, generate_subscripts(found, 1)::INT - 1 AS place FROM s) SELECT lyrics_id, place, CAST(s AS DOUBLE) AS value FROM u",
}
_LOADED = " UNION ALL ".join(f'SELECT doc_id, start, "end" FROM ({ORACLES[name]})' for name in ("a19_vtt_cues", "a20_lrc_cues", "a23_plain_cues"))
ORACLES["a18_loaded_documents"] = f"""WITH loaded AS ({_LOADED}), spans AS (SELECT doc_id, count(*) AS cues, round(min(start), 3) AS first, round(max("end"), 3) AS last FROM loaded GROUP BY 1)
SELECT d.doc_id, doc_kind, coalesce(cues, 0) AS cues, first, last, cues IS NULL AS refused FROM documents d LEFT JOIN spans USING (doc_id) WHERE doc_kind IN ('vtt', 'lrc', 'sheet')"""
