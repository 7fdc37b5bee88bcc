import random

import pyarrow as pa
import pytest

from tidemark.llm import pii
from tidemark.llm.spans import Spans

CASES = [
    ("Mail ada.moss@quick.example.org today", "email"), ("reach ada (at) quick (dot) example (dot) org", "email"), ("write ADA AT quick DOT example", "email"), ("аda@quick.example.com now", "email"),
    ("ring +44 7700 900123 later", "phone"), ("cell: 16135550160", "phone"), ("Call me on (829) 555-0198 after six", "phone"), ("my line is six one three five five five oh one six zero ok", "phone"),
    ("tel. ０３０ 23125 366", "phone"), ("My social is 945-96-2891.", "id_number"), ("SSN 976773716 for the check", "id_number"), ("NI number QQ 12 34 56 C it says", "id_number"),
    ("Mi DNI es 00000520Y.", "id_number"), ("identity card L0FCC3C43 here", "id_number"), ("come to 12b Thistle St., Little Ansley", "address"), ("at 50 rue des Verriers, back door", "address"),
    ("am Haus Lindenweg 95, 00987 Ort", "address"), ("vive en Calle de la Noria 43, 4º A", "address"), ("send it to 435 w. priory ave. please", "address"),
    ("My landlord, Greta Velello, said no", "person_name"), ("thanks to Professor Wexbury for it", "person_name"), ("by Lindfen, Selma today", "person_name"), ("my landlord, nora ostranger, said", "person_name"),
]
PLAIN = [
    "Order 8759-55-5455 still says pending.", "ISBN 978-0-00-466312-8 in case", "The high score is 5558287", "serial 453-134-54 is stamped", "route 79 past Little Ansley Road is closed", "pinned it to tool@9.7.6",
    "meet @ the usual place, 6:30", "thanks u/quiet_paper25, that did it", "We walked down Thistle Street and got lost", "ask for the Silver Kettle at the bar", "I talked to Harrow Library about it", "12 main roads lead there",
    "I spent 5 days on the court", "ticket 98239 was closed on 2019-05-11", "Version 3.16.15 fixed it, build 91673", "it rose twice as high, mark my words", "about 210 485 people voted",
]


@pytest.mark.parametrize("text,kind", CASES)
def test_found(text, kind):
    assert {k for *_, k in pii.find(text)} == {kind}
    assert pii.candidates(pa.array([text])).to_pylist() == [True]
    assert f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", PLAIN)
def test_not_found(text):
    assert pii.find(text) == [] and pii.redact(text) == text


CONTEXT = ["My neighbour Sabine Kowalska called again", "My boss, Xavier Dupont, told us", "thanks to Obinna Adeyemi, who fixed it", "Deepika Reddy said it would rain and Anton Q. Verhoeven agreed"]
THINGS = ["My neighbour said the Silver Kettle called it a night", "Good Morning said the sign", "We met at Iris Lantern and it was fine", "Then Little Ansley said no", "the Rose Harvest called for rain"]


@pytest.mark.parametrize("text", CONTEXT)
def test_names_by_context(text):
    assert {k for *_, k in pii.find(text)} == {"person_name"}
    assert pii.candidates(pa.array([text])).to_pylist() == [True]


def test_without_context_these_names_are_not_told(monkeypatch):
    for kind in ("relation", "doing"):
        monkeypatch.setitem(pii.POINTS, kind, 0.0)
    assert all(pii.find(text) == [] for text in CONTEXT[:3])


@pytest.mark.parametrize("text", THINGS)
def test_capitals_alone_are_no_names(text):
    assert pii.find(text) == []


FORMS = ["ring 613–555–0160", "write ada AT quick.example.com", "mail bob AT mail.quick.org", "id 945‑96‑2891", "kofi.mensah at example.org", "call 613\u00a0555\u00a00160", "my line is six–one–three–five–five–five–oh–one–six–zero", "au 12bis rue des Verriers", "au 12 bis, rue des Verriers",
         "calle\tde la Noria 43", "ssn ٣٤٥-96-2891", "double-six one one two three four five six seven"]


@pytest.mark.parametrize("text", FORMS)
def test_disguises_pass_the_prefilter(text):
    assert pii.find(text), text
    assert pii.candidates(pa.array([text])).to_pylist() == [True]


def test_find_implies_candidate():
    rnd = random.Random(12)
    disguise = {" ": " \u00a0\u2009\u202f", "-": "-‐‑–—−", "a": "aаα", "e": "eе", "o": "oоο", "1": "1１", "0": "0０", ".": ".．", "@": "@＠"}
    bases = [t for t, _ in CASES] + FORMS + CONTEXT
    for _ in range(3000):
        text = "".join(rnd.choice(disguise[c]) if c in disguise and rnd.random() < 0.25 else c for c in rnd.choice(bases))
        if rnd.random() < 0.3:
            text = text.replace(" ", rnd.choice(["  ", "\t", "\n", " "]), 1)
        if pii.find(text):
            assert pii.candidates(pa.array([text])).to_pylist() == [True], text


def test_offsets_point_into_the_source():
    text = "x\u200bx Caf\u00e9 mail me: j\u043eel (at) velmail [dot] example or four four one five five five zero one two six, thanks"
    spans = pii.find(text)
    assert [k for *_, k in spans] == ["email", "phone"]
    assert text[spans[0][0] : spans[0][1]].endswith("example") and text[spans[1][0] : spans[1][1]].startswith("four four") and text[spans[1][0] : spans[1][1]].endswith("six")


def test_rewrite_keeps_offsets():
    import re

    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice("ab（１２\u200b –x") for _ in range(30))
        s = Spans(text).fold().rewrite(re.compile("a+"), lambda m: "Z")
        for i in range(len(s.text)):
            a, b = s.source(i, i + 1)
            assert 0 <= a < b <= len(text)
            assert s.text[i] == "Z" or Spans(text[a:b]).fold().text == s.text[i]


def test_empty_and_long():
    assert pii.find(None) == pii.find("") == pii.find("  \n ") == []
    assert pii.redact(None) is None
    long = "nothing here. " * 200_000 + "ring +44 7700 900123."
    assert [k for *_, k in pii.find(long)] == ["phone"]


def test_tables(spark):
    items = spark.createDataFrame([("i1", "x"), ("i1", "My social is 945-96-2891."), ("i1", "My social is 945-96-2891."), ("i2", None), (None, "SSN 976773716")], "item_id string, body string")
    chunks = spark.createDataFrame([("c:0", "a\n\nby Lindfen, Selma today", 1)], "chunk_id string, text string, pii_type int")
    got = {tuple(r) for r in pii.found(items, chunks).collect()}
    assert got == {("items", "i1", "id_number"), ("items", None, "id_number"), ("chunks", "c:0", "person_name")}
    assert pii.found(items.limit(0), chunks.limit(0)).count() == 0
    red = pii.redacted(chunks, "text").collect()
    assert red[0].text == "a\n\nby [PERSON_NAME] today" and red[0].pii_type == 1
