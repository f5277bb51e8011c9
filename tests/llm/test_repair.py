from __future__ import annotations

from measura.llm.encoding import CHAINS, garbled_fields, oddness, restore_line, undo
from measura.llm.unify import folded, ordinary, script_repairs, unify

CLEAN = ["La forêt brûlée au bord de la rivière", "Der müde Kapitän fährt über den Fluss", "El corazón de papel y una niña de sal", "Mon père a laissé la clé rouillée", "Uma oração de sal e um avião de lata", "Серебряный свисток над рекой", "Медный фонарь под старым мостом", "最後のフェリーと青いヨット"]


def test_undo_is_the_inverse_of_a_wrong_decoding():
    for text in CLEAN:
        for wrong, true in CHAINS:
            try:
                garbled = text.encode(true).decode(wrong)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if garbled != text:
                assert undo(garbled, wrong, true) == text


def test_multi_byte_lines_come_back_even_twice_garbled():
    twice = CLEAN[0].encode().decode("cp1252").encode().decode("cp1252")
    assert restore_line(twice, [("cp1252", "utf-8")])[0] == CLEAN[0]
    for text in CLEAN:
        assert restore_line(text, [("cp1252", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "cp932")])[:2] == (text, False)
    latin = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in CLEAN[4].encode("euc_jp"))
    assert restore_line(latin, [("cp1252", "utf-8"), ("cp1252", "euc_jp")])[0] == CLEAN[4]


def test_oddness_tells_words_from_garbage():
    assert all(oddness(t) == 0 for t in CLEAN + ["Café & Bar", "MÜDE", "♪ la la ♪"])
    assert oddness("brÃ»lÃ©e") > 0 and oddness("яЕПЕАПЪМШИ") > 0 and oddness("L├╢vse") > 0


def test_fields_are_found_and_restored(spark):
    rows = [(i, t, "keep") for i, t in enumerate(CLEAN * 6)]
    bad = {1000: CLEAN[0].encode().decode("cp1252"), 1001: CLEAN[1].encode().decode("cp1252"), 1002: CLEAN[2].encode().decode("cp1252"), 1003: CLEAN[5].encode("koi8_r").decode("cp1251"), 1004: CLEAN[6].encode("koi8_r").decode("cp1251"), 1005: CLEAN[3].replace("é", "?").replace("è", "?"), 1006: CLEAN[4].replace("ç", "�").replace("ã", "�"), 1007: f"[00:01.00] {CLEAN[2]}\r\n[00:02.00] {CLEAN[0].encode().decode('cp1252')}"}
    want = {1000: CLEAN[0], 1001: CLEAN[1], 1002: CLEAN[2], 1003: CLEAN[5], 1004: CLEAN[6], 1005: CLEAN[3], 1006: CLEAN[4], 1007: f"[00:01.00] {CLEAN[2]}\r\n[00:02.00] {CLEAN[0]}"}
    rows += [(k, v, None) for k, v in bad.items()] + [(1000, bad[1000], None), (2000, None, "x"), (2001, "", "x"), (2002, "   ", "x")]
    df = spark.createDataFrame(rows, "id long, text string, line string")
    got = {r.id: r.restored for r in garbled_fields(df, ["id"], "text").collect()}
    assert got == want
    assert garbled_fields(df.limit(0), ["id"], "text").count() == 0


def test_ordinary_form():
    cases = {"Ｌａｕｆ　ｍｉｔ": "Lauf mit", "été": "été", "quiet ⁠​engine": "quiet engine", "my father’s": "my father's", "a b c": "a b c", "𝐓𝐡𝐞 ﬁn": "The fin", "ﾗﾝﾌﾟ": "ランプ", "co‐op": "co-op", "K\xad": "K"}
    for raw, plain in cases.items():
        assert ordinary(raw) == plain and ordinary(plain) == plain
    for same in ("naïve Straße", "Тёмный", "最後のフェリー", "“quoted” – dash…", "❤️ 👩‍🎤", "½ ª º"):
        assert ordinary(same) == same


def test_scripts_are_repaired_word_by_word():
    assert script_repairs("the sаlt rоad") == [("sаlt", "salt"), ("rоad", "road")]
    assert script_repairs("Ι left а road") == [("Ι", "I"), ("а", "a")]
    assert script_repairs("Ты как старый плащ, а я") == [] and script_repairs("Live in Москва") == []
    assert script_repairs("пoловинe") == [("пoловинe", "половине")]
    assert folded("Thе SΑLT") == "the salt"


def test_unify_lists_what_is_not_in_the_form(spark):
    rows = [(1, "the salt road", "a"), (2, "the sаlt road", "a"), (3, "the salt road", "a"), (3, "the salt road", "b"), (4, None, "a"), (5, "", "a"), (6, "Zαxq gone", "a")]
    df = spark.createDataFrame(rows, "id long, text string, original string")
    got = {r.id: r.unified for r in unify(df, ["id"], "text").collect()}
    assert got == {2: "the salt road", 3: "the salt road", 6: "Zαxq gone"}  # the last is listed, its repair isn't in the vocabulary
    assert unify(df.limit(0), ["id"], "text").count() == 0


def test_words_that_happen_to_be_bytes_stay():
    chains = [("cp866", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "utf-8"), ("cp1252", "cp932")]
    for text in ("чем дальше", "Тёмный лес", "сад", "Dе Ceniza", "Döörrholm", "MAÇÃ"):
        assert restore_line(text, chains)[:2] == (text, False)


def test_chains_outside_the_menu_are_learned(spark):
    """A codec that is in no list: its mapping comes from the twins."""
    assert ("iso8859_2", "mac_latin2") not in CHAINS
    clean = ["Zażółć gęślą jaźń nad rzeką", "Błękitny żagiel obok latarni", "Złamany grzebień i łódź", "Pożyczony bęben przez cichą noc"]
    garbled = [t.encode("mac_latin2").decode("iso8859_2") for t in clean[:3]]
    rows = list(enumerate(clean * 5)) + [(100 + i, g) for i, g in enumerate(garbled)]
    got = {r.id: r.restored for r in garbled_fields(spark.createDataFrame(rows, "id long, text string"), ["id"], "text").collect()}
    assert got == {100 + i: t for i, t in enumerate(clean[:3])}


def test_one_garbled_title_is_enough_in_a_small_corpus(spark):
    title = "銅のランプ"
    garbled = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in title.encode("cp932"))
    rows = [(1, title), (2, title), (3, garbled), (4, "Plain Road"), (5, f"{garbled} (Acoustic)")]
    got = {r.id: r.restored for r in garbled_fields(spark.createDataFrame(rows, "id long, text string"), ["id"], "text").collect()}
    assert got == {3: title, 5: f"{title} (Acoustic)"}
