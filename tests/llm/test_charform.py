import pytest

from plumbline.llm.charform import fields, plain_look, repairs, same_keys, signs, visual_form, words


@pytest.mark.parametrize(
    ("damaged", "clean"),
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ！", "full width!"),
        ("𝗇𝗈𝖻𝗈𝖽𝗒 𝐛𝐨𝐥𝐝", "nobody bold"),
        ("café", "café"),
        ("ze​ro⁠ wi­dth﻿", "zero width"),
        ("a b c d", "a b c d"),
        ("oﬃce", "office"),
        ("Ѕee the pаrсel, tһe һeadlіne", "See the parcel, the headline"),
        ("critiϲs and օffice", "critics and office"),
        ("MОRON", "MORON"),
        ("Почему пoезд", "Почему поезд"),
    ],
)
def test_same_look(damaged, clean):
    assert visual_form(damaged) == clean


@pytest.mark.parametrize("text", ["", "plain", "tab\tand\nline  breaks", "“quotes” – dashes — kept", "Почему поезд опять", "x² ½ ①", "👩‍💻 work", "MiXeD CaSe"])
def test_left_alone(text):
    assert visual_form(text) == text


def test_joiner_is_dropped_each_time():
    assert [visual_form("a‍b")] * 3 == [visual_form("a‍b") for _ in range(3)] == ["ab"] * 3


def test_repair_keeps_names_in_other_scripts_text():
    found = repairs(plain_look("Этот комментарий из Novugu опять скучный"))
    assert found == {}


def test_forms_are_stable():
    for t in ["Ѕο сһeér", "ｆﬀ𝐛 x", "Straße İstanbul"]:
        assert visual_form(visual_form(t)) == visual_form(t)


def test_signs_and_words():
    assert signs("Straße") == signs("STRASSE") == "strasse"
    assert signs("café") != signs("cafe")
    assert words("Don't STOP_now, né 3x") == ["don", "t", "stop", "now", "né", "3x"]
    assert signs("-- !? _") == "" and words("") == []


def test_fields():
    want = {("name", "ann"), ("mood", "calmday")}
    for t in ['{"name": "Ann", "mood": "Calm day"}', "mood: calm day | name: ann", "name=Ann; mood=Calm, day", "Mood: calm day\nName: Ann"]:
        assert {(signs(k), signs(v)) for k, v in fields(t)} == want
    assert fields("Source: a plain text with a prefix") is None
    assert fields("no fields here") is None and fields("{broken: json") is None
    assert same_keys("a: x | b: y")[1] == same_keys('{"b": "Y", "a": "x!"}')[1]
    assert same_keys("a: x | b: y")[1] != same_keys("a: y | b: x")[1]
