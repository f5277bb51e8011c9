from __future__ import annotations

from measura.sources import timed_text as P


def _df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_lrc_stamps_words_and_ends(spark):
    df = _df(spark, "[ti:x]\n[00:01.00][00:05.50]Run <i>away</i>\r\n[00:03.00]  \n[00:04.00]Stay", None, "")
    got = [(r.id, r.start, r.end, r.text) for r in P.parse_lrc(df, "id", "text").orderBy("start").collect()]
    assert got == [(0, 1.0, 4.0, "Run away"), (0, 4.0, 5.5, "Stay"), (0, 5.5, 10.5, "Run away")]
    words = P.parse_lrc_words(_df(spark, "[00:01.00]<00:01.00>Run <00:01.50>away"), "id", "text").orderBy("word_ix").collect()
    assert [(w.start, w.word) for w in words] == [(1.0, "Run"), (1.5, "away")]
    seen = df.select(P.looks_like_lrc(df.text).alias("x")).collect()
    assert [r.x for r in seen] == [True, None, False]


def test_blocks_of_captions(spark):
    vtt = "WEBVTT\n\nNOTE nothing\n\n1\n00:01.000 --> 00:02.500 align:start\n<c>One</c> &amp;\ntwo\n\n00:00:03,000 --> 00:00:04,000\n\n\nbad --> worse\nthree"
    got = [(r.start, r.end, r.text) for r in P.parse_blocks(_df(spark, vtt, None), "id", "text").collect()]
    assert got == [(1.0, 2.5, "One & two")]


def test_plain_lines_share_the_time(spark):
    from pyspark.sql import functions as F

    got = [(r.start, r.end, r.text) for r in P.plain_cues(_df(spark, "a\n\n b \n"), "id", "text", F.lit(10.0)).orderBy("line_ix").collect()]
    assert got == [(0.0, 5.0, "a"), (5.0, 10.0, "b")]


def test_json_documents_are_taken_whole(spark):
    docs = _df(spark, '[{"start": 0, "end": 1, "text": "a"}, {"start": 1, "end": 2, "text": "b"}]', '[{"start": 0, "end": 1, "text": "a"}, {"start": 5, "end": 2, "text": "b"}]', "{", "[]", '[{"start": 0, "end": 1}]')
    got = {(r.id, r.text, r.reject) for r in P.json_cues(docs, "id", "text").collect()}
    assert {x for x in got if x[0] == 0} == {(0, "a", None), (0, "b", None)}
    assert {x[0]: x[2] for x in got if x[0]} == {1: "malformed cue", 2: "unreadable", 3: "empty", 4: "malformed cue"} or {x[0] for x in got if x[2]} == {1, 2, 3, 4}
