from __future__ import annotations

import numpy as np
import pytest

from measura.llm.abuse import IDENTITY_TERMS, SWAP_PENALTY, AbuseModel, _mentions, _swaps, abuse_scores, labelled, sentences, words
from measura.llm.language import BiGru, _padded, label_code, line_text, record_languages, stretches


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    net = BiGru(["a", "b", "c"], hidden=5, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = _padded([b"hello", b"abc", b"zz"])
    y = np.array([0, 1, 2])

    def loss():
        q = net.probabilities(x, mask)
        k = len(net.codes)
        smooth = np.full(q.shape, 0.1 / k)
        smooth[:, np.arange(3), y] += 0.9
        return -float((np.log(q) * smooth * mask[:, :, None]).sum() / mask.sum())

    _, g = net._gradient(x, mask, y, rng, drop=0.0)
    for name in net.p:
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in [k for k in range(len(flat)) if abs(grad[k]) > 1e-6][:12]:
            keep = flat[i]
            flat[i] = keep + 1e-4
            up = loss()
            flat[i] = keep - 1e-4
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-4 - grad[i]) < 2e-3 * max(1, abs(grad[i])), name


@pytest.fixture(scope="module")
def net(spark, small):
    rows = spark.read.parquet(f"{small}/language_samples.parquet").orderBy("sample_id").collect()
    fit, held = [r for r in rows if r.sample_id % 5], [r for r in rows if r.sample_id % 5 == 0]
    return BiGru.fit([r.text for r in fit], [r.language_code for r in fit], epochs=70), held


def test_held_out_accuracy(net):
    model, held = net
    q = model.lines([line_text(r.text.replace("\n", " ")) for r in held])
    right = sum(model.codes[k] == r.language_code for k, r in zip(q.argmax(1), held, strict=True))
    assert right / len(held) >= 0.9


def test_lines_are_read_whole_whatever_stands_beside_them(net):
    model, held = net
    texts = sorted((line_text(r.text).encode() for r in held[:12]), key=len, reverse=True)
    logits, size = model.logits(texts)
    x, mask = _padded(texts)
    want = model.probabilities(x, mask)
    e = np.exp(logits)
    assert size.tolist() == [len(t) for t in texts]
    assert np.abs((e / e.sum(2, keepdims=True) - want) * mask[:, :, None]).max() < 1e-4
    long = " ".join(line_text(r.text) for r in held[:40] if r.language_code == "fr") * 60
    q = model.lines(["", long, "x"])
    assert model.codes[q[1].argmax()] == "fr" and q.shape[0] == 3


def test_stretches_of_a_line(net):
    model, held = net
    one, other = (" ".join(next(line_text(r.text) for r in held if r.language_code == c).split()[:8]) for c in ("ru", "es"))
    text = f"{one} {other}".encode()
    (_, logs, _), = list(model.positions([text]))
    got = stretches(logs[:, 0], text)
    assert [model.codes[k] for k, _, _ in got] == ["ru", "es"] and sum(n for _, _, n in got) == 16
    text = one.encode()
    (_, logs, _), = list(model.positions([text]))
    assert [(model.codes[k], n) for k, _, n in stretches(logs[:, 0], text)] == [("ru", 8)]


def test_lines_without_words_and_labels(spark):
    assert [line_text(x) for x in ("[Music]", "la la la", "Oh oh!", "♪", "12:30", "")] == [""] * 6
    labels = ["en-US", "ENG", "es-419", "ger", "und", "??", "", None, "auto", "Deutsch", "pt_BR", "xx"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(label_code("l")).collect()]
    assert got == ["en", "en", "es", "de", None, None, None, None, None, "de", "pt", None]


def test_records(spark, net):
    model, _ = net
    rows = [("a", 1, i, "And I can't forget the slow train before the morning") for i in range(3)] + [("a", 1, 9, "[music]"), ("a", 1, 10, None), ("a", 1, 11, " "), ("b", 2, 0, "Guardamos el último tren donde estaba el año pasado"), ("b", 2, 0, "Guardamos el último tren donde estaba el año pasado")]
    df = spark.createDataFrame(rows, "kind string, rec long, item long, text string").selectExpr("*", "'x' AS lang")
    got = sorted((r.kind, r.item, r.lang) for r in record_languages(df, model, ["kind", "rec"], "item", "text").collect())
    assert got == [("a", 0, "en"), ("a", 1, "en"), ("a", 2, "en"), ("b", 0, "es")]
    assert record_languages(df.limit(0), model, ["kind", "rec"], "item", "text").count() == 0


def test_words_undo_disguises():
    assert words("You par@$1te, b***h!") == ["you", "parasite", "b*h5"]
    assert words("c o n n a r d") == ["conard"] and words("losssser") == ["loser"]
    assert sentences("low_e: One two. Three!\n[00:12.10] four") == ["One two.", "Three!", "four"]


def test_model_tells_abuse_from_loaded_words(spark):
    fine = ["We played the slow train on Sunday.", "This stupid string broke again.", "I could strangle this capo.", "Women play in our house band.", "The bridge needs more than three fingers.", "Immigrants from three countries play with us."]
    bad = ["You are a stupid idiot, nobody wants you here.", "Go home, you filthy idiot.", "Women are vermin and should be gone.", "Shut your mouth, you filthy loser."]
    texts = [f"{fine[i % 6]} {fine[(i * 5 + 1) % 6]}" for i in range(120)] + [f"{fine[i % 6]} {bad[i % 4]}" for i in range(40)]
    model = AbuseModel.fit(texts, [0] * 120 + [1] * 40)
    score = model.scorer()
    assert min(score(b) for b in bad) > max(score(f) for f in fine)
    assert abs(score("Women are vermin and should be gone.") - score("Muslims are vermin and should be gone.")) < 0.5
    docs = spark.createDataFrame([(1, bad[0] + "\n" + fine[0] * 50), (2, None), (3, ""), (4, fine[0]), (4, fine[0])], "doc_id long, text string").selectExpr("*", "0.5 AS score")
    got = {r[0]: r[1] for r in docs.select("doc_id", abuse_scores(docs, model).alias("s")).collect()}
    assert got[1] > got[4] and got[2] == got[3] == 0.0
    assert AbuseModel.fit([], []).scorer()("anything") < 0.5


def test_every_identity_term_is_reached():
    for line, terms in IDENTITY_TERMS.items():
        for term in terms.split():
            tokens = words(f"quiz {term} quiz")
            assert len(_mentions(tokens)) == 1, (line, term)
            swapped = _swaps(tokens, np.random.default_rng(1))
            assert len(swapped) == 2 and all(s[0] == s[-1] == "quiz" and len(_mentions(s)) == 1 for s in swapped)
    assert _swaps(words("nobody is named here"), np.random.default_rng(1)) == []


def test_the_swap_penalty_spares_neutral_mentions():
    """Abuse in the labelled texts names two groups mostly; neutral mentions of these groups must not be taken for it."""
    bad = ["{} are vermin", "{} are filth and should be gone", "all {} are liars", "nobody wants {} here", "{} ruin every town"]
    fine = ["the river was calm on day {}", "we tuned the strings for show {}", "the train left at {}", "song {} needs a new bridge", "chord {} is hard to hold"]
    texts, labels = [], []
    for i in range(300):
        texts.append(" ".join(f"{fine[(i + k) % 5].format(i)}." for k in range(3)))
        labels.append(0)
        if i % 3 == 0:
            texts[-1] += f" {bad[i % 5].format(('muslims', 'women')[i % 2])}."
            labels[-1] = 1
        elif i % 10 == 1:
            texts[-1] += f" {('asians', 'catholics')[i % 2]} play in our band."
    neutral = [t.format(g) for g in ("muslims", "women") for t in ("{} play in the band on sunday", "we met three {} at the show", "many {} live beside the river", "{} sang the second verse", "a choir of {} came by train")]
    false = {}
    for penalty in (0.0, SWAP_PENALTY):
        model = AbuseModel.fit(texts, labels, swap_penalty=penalty)
        score = model.scorer()
        false[penalty] = sum(score(t) >= model.threshold for t in neutral), float(np.mean([score(t) for t in neutral]))
        assert score("muslims are vermin") >= model.threshold
    assert false[SWAP_PENALTY] < false[0.0]


def test_languages_with_few_verdicts_are_abstained_in(spark):
    fine, bad = "We played the slow train on day {}.", "You are a stupid idiot, go home."
    texts = [fine.format(i) for i in range(60)] + [f"{fine.format(i)} {bad}" for i in range(12)] + ["Jeg er en dum idiot og du er værre", "Vi spillede sangen i går", "Toget kører langsomt i dag"]
    labels, groups = [0] * 60 + [1] * 12 + [1, 0, 0], ["en"] * 72 + ["da"] * 3
    model = AbuseModel.fit(texts, labels, groups)
    score = model.scorer()
    assert score(bad) >= model.threshold
    assert all(score(t) < model.threshold for t in ("Vi spillede sangen igen", "Toget er sent på den", "Jeg er træt i dag og du er glad"))


def test_verdicts_that_disagree_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", None), (3, None, "en"), (4, "d", "da")], "doc_id long, text string, lang string")
    said = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, verdict int")
    assert sorted(labelled(docs, said, group="lang")) == [("b", 1, None), ("d", 0, "da")]
    assert labelled(docs.limit(0), said) == [] == labelled(docs, said.limit(0))
