"""Queries that once left part of their input out, over small tables that hold such rows."""

from __future__ import annotations

from measura.llm.abuse import AbuseModel, labelled, sentences
from measura.llm.q_names import p6_links
from measura.llm.q_repair import p1_found, p2_found


def test_lyrics_tell_which_titles_are_garbled(spark, tmp_path):
    garbled = lambda t: t.encode().decode("cp1252")
    title, act = "Voilà la rivière perdue", "Zéphyr À Grenoble"
    sheets = ["Où est le café bleu de la rivière", "Voilà le théâtre près de la fenêtre", "La forêt brûlée derrière le château", "Le garçon préféré rêve déjà là"]
    lyrics = [t for s in sheets for t in (s, s, garbled(s))]
    tables = {
        "media_metadata": ("song_id long, title string, artist string", [(1, garbled(title), garbled(act)), (2, "Plain Road", "Some Band")]),
        "embedded_lyrics": ("lyrics_id long, text string", list(enumerate(lyrics))),
        "raw_cues": ("cue_id long, text string", [(1, "a plain line")]),
        "artist_registry": ("artist_id long, act_name string", [(10, act), (11, "Some Band")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    media = {(r.rec_id, r.field_name) for r in p1_found(spark, d).where("rec_kind = 'media'").collect()}
    assert media == {(1, "title"), (1, "artist")}
    assert p2_found(spark, d).count() == 0
    assert {(r.song_id, r.artist_id) for r in p6_links(spark, d).collect()} == {(1, 10), (2, 11)}


def test_the_end_of_a_long_document_is_labelled(spark):
    calm = [f"The river was calm on day {i}." for i in range(400)]
    rows = [(1, " ".join([*calm, "you are a worthless fool."])), (2, " ".join(calm)), (3, "bob: one line\n[00:01.00] one line\r\n\u00a0- other line.")]
    pairs = labelled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, verdict int"))
    once = lambda t: list(dict.fromkeys(sentences(t)))
    assert sorted((once(p), v) for p, v, _ in pairs) == sorted((once(t), int(i == 1)) for i, t in rows)


def test_abuse_at_the_end_of_long_documents_is_learnt():
    calm = lambda d: " ".join(f"The river was calm on day {i} of year {d}." for i in range(220))
    texts = [calm(d) + (" You are a worthless fool." if d % 4 == 0 else " Good night to all.") for d in range(40)]
    score = AbuseModel.fit(texts, [int(d % 4 == 0) for d in range(40)]).scorer()
    assert min(map(len, texts)) > 6000 and score("You are a worthless fool.") > 0.5 > score("Good night to all.")
