"""Queries of algorithms that fold a whole run, document or pair: no SQL says the same, tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from measura.functions import text as X
from measura.functions.speech import ONES, TENS
from measura.operators.alignment import align_pairs
from measura.operators.captions import folded_resends, merge_captions, normalise_cues
from measura.operators.fingering import fingerings
from measura.plans.catalogue import f4_best_sheet
from measura.plans.notes import selected
from measura.plans.sequences import d10_choose_attempt
from measura.session import table
from measura.sources import timed_text as P
from measura.sources.bind import load_cues, load_words


def e20_fingering(spark, d):
    """String and fret of each selected note along the cheapest path through its run."""
    return fingerings(selected(spark, d), "run_id", "anchor")


def alignment_pairs(spark, d):
    """(song_id, lyrics_id, attempt_id, text, cues, duration): each attempt with the sheet chosen for its song, each sheet with the attempt chosen.

    Every sheet and every attempt of a song is aligned, in as many pairs as there are of both together.
    """
    sheets = table(spark, d, "embedded_lyrics").where(F.trim("text") != "").select("song_id", "lyrics_id", F.regexp_replace("text", r"\[[0-9:.]+\]", " ").alias("text")).dropDuplicates(["lyrics_id"])
    attempts = table(spark, d, "attempts").select("song_id", "attempt_id").distinct()
    best_sheet = f4_best_sheet(spark, d).select("song_id", "lyrics_id")
    best_attempt = d10_choose_attempt(spark, d).select("song_id", "attempt_id")
    pairs = attempts.join(best_sheet, "song_id").unionByName(sheets.select("song_id", "lyrics_id").join(best_attempt, "song_id")).distinct()
    words = load_words(spark, d).groupBy("cue_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("words"))  # words of one cue
    cues = load_cues(spark, d).join(words, "cue_id", "left").groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text", "words"))).alias("cues"))  # cues of one recording
    duration = table(spark, d, "media_metadata").where("duration > 0").groupBy("song_id").agg(F.max("duration").alias("duration"))
    return pairs.join(sheets.drop("song_id"), "lyrics_id").join(duration, "song_id", "left").join(cues, "attempt_id", "left")


def j13_alignment(spark, d):
    """Report of aligning the sheets of a song with its attempts, in the pairs of ``alignment_pairs``."""
    return align_pairs(alignment_pairs(spark, d), ["song_id", "lyrics_id", "attempt_id"], "text", "cues", "duration")


def e11_word_times(spark, d):
    """Words of the same pairs with the times they are given: measured where matched, laid out between where not."""
    return align_pairs(alignment_pairs(spark, d), ["song_id", "lyrics_id", "attempt_id"], "text", "cues", "duration", timed=True)


def e3_folded_resends(spark, d):
    """Decoder cues of each attempt without lines that are sent again."""
    return folded_resends(load_cues(spark, d), "attempt_id").drop("words")


def e4_merged_captions(spark, d):
    """Cues of each caption document with re-sends folded and fragments joined."""
    return merge_captions(P.parse_blocks(table(spark, d, "documents").where("doc_kind = 'vtt'"), "doc_id", "text").select("doc_id", "start", "end", "text"), "doc_id").drop("words")


def e8_normalised_cues(spark, d):
    """All passes over the decoder cues of each attempt, with their words, until nothing changes; the duration of the song ends them."""
    words = load_words(spark, d).groupBy("cue_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("words"))
    song = table(spark, d, "attempts").select("attempt_id", "song_id").distinct()
    duration = table(spark, d, "media_metadata").where("duration > 0").groupBy("song_id").agg(F.max("duration").alias("duration"))
    cues = load_cues(spark, d).join(words, "cue_id", "left").join(song.join(duration, "song_id"), "attempt_id", "left")
    out = normalise_cues(cues, "attempt_id")
    return out.select("attempt_id", "cue_ix", "start", "end", "text", F.size("words").alias("n_words"))


def h2_folded(spark, d):
    return load_cues(spark, d).select("cue_id", X.folded("text").alias("folded"))


def h5_spoken_numbers(spark, d):
    return table(spark, d, "media_metadata").select("song_id").distinct().select("song_id", X.spoken_number(F.col("song_id").cast("string")).alias("words"))


def h17_display_width(spark, d):
    return load_cues(spark, d).select("cue_id", X.display_width("text").alias("cells"))


QUERIES = {f.__name__: f for f in (e20_fingering, j13_alignment, e11_word_times, e3_folded_resends, e4_merged_captions, e8_normalised_cues, h2_folded, h5_spoken_numbers, h17_display_width)}
_ONES, _TENS = (f"[{', '.join(repr(w) for w in words)}]" for words in (ONES, TENS))
_REST = lambda words, n: f"CASE WHEN {n} > 0 THEN ' ' || {words(n)} ELSE '' END"
_ONE = lambda n: f"{_ONES}[{n} + 1]"
_HUNDRED = lambda n: f"CASE WHEN {n} < 20 THEN {_ONE(n)} ELSE {_TENS}[{n} // 10 - 1] || {_REST(_ONE, f'({n} % 10)')} END"
_THOUSAND = lambda n: f"CASE WHEN {n} >= 100 THEN {_ONE(f'{n} // 100')} || ' hundred' || {_REST(_HUNDRED, f'({n} % 100)')} ELSE {_HUNDRED(n)} END"
ORACLES = {
    "h5_spoken_numbers": f"""WITH m AS (SELECT DISTINCT song_id, song_id AS n FROM media_metadata) SELECT song_id, CASE WHEN n >= 1000000 THEN array_to_string(list_transform(string_split(n::VARCHAR, ''), lambda c: {_ONES}[c::INT + 1]), ' ')
WHEN n BETWEEN 1100 AND 2099 AND n % 100 >= 10 THEN ({_HUNDRED("(n // 100)")}) || ' ' || ({_HUNDRED("(n % 100)")}) WHEN n >= 1000 THEN ({_THOUSAND("(n // 1000)")}) || ' thousand' || {_REST(_THOUSAND, "(n % 1000)")} ELSE {_THOUSAND("n")} END AS words FROM m""",
}
