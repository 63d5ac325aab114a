import random
import re
import time

import pytest

from symptia.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


@pytest.mark.parametrize("letters", ["a@.-_9 ", "19.2 +()-", "a@b.c-1+ 0"])
def test_plain_spans_are_those_of_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text, kind, hidden", [
    ("write john.smith [at] example [dot] com now", "email", "john.smith [at] example [dot] com"),
    ("mail jo (at) ex.org please", "email", "jo (at) ex.org"),
    ("reach joe at example dot com today", "email", "joe at example dot com"),
    ("jοhn@exаmple.com", "email", "jοhn@exаmple.com"),
    ("x john​.x@ex​ample.com y", "email", "john​.x@ex​ample.com"),
    ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
    ("+１ 555 123 4567 ok", "phone", "+１ 555 123 4567"),
    ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
    ("ip 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
    ("pay four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
])
def test_disguises(text, kind, hidden):
    assert [text[a:b] for a, b in pii.all_spans(text)[kind]] == [hidden]


@pytest.mark.parametrize("text", ["look at this dot here", "call one of two or three people at 5", "we meet at noon dot.", "", "das ist ein Punkt"])
def test_ordinary_words_are_left_alone(text):
    assert not any(pii.all_spans(text).values())


def test_plain_spans_stay_beside_disguised_ones():
    text = "a@b.co and c [at] d.org, é@x 漢 1.2.3.4"
    found = pii.all_spans(text)
    assert set(pii.base_spans(text)["email"]) <= set(found["email"]) and len(found["email"]) == 2 and len(found["ip"]) == 1


@pytest.mark.parametrize("text", ["a" * 300_000, "1." * 50_000, "1" * 200_000, "+1" + "-" * 200_000, "one " * 50_000, "(at)" * 50_000,
                                  "a dot " * 30_000, "@" * 100_000, "a@" * 100_000, "a at " + "b dot " * 20_000])
def test_long_texts_take_linear_time(text):
    start = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - start < 5


def test_documents(edges, docs):
    assert {r.doc_id: r.spans for r in pii.find_personal_data(edges).collect()}[8] == ""
    rows = pii.find_personal_data(docs([(1, None), (2, "a@b.co"), (2, "a@b.co"), (3, "é +1 555 123 4567")])).collect()
    assert sorted((r.doc_id, r.n_email, r.n_phone, r.spans) for r in rows) == [
        (1, 0, 0, ""), (2, 1, 0, "email:0:6"), (2, 1, 0, "email:0:6"), (3, 0, 1, "phone:2:17")]
    assert pii.find_personal_data(docs([])).collect() == []


def test_redaction_keeps_columns(docs):
    got = pii.redact(docs([(1, "to a@b.co or c [at] d.org."), (2, None)]), "text", n_chars="place").orderBy("doc_id").collect()
    assert got[0].text == "to [EMAIL] or [EMAIL]." and got[0].place == 22 and got[1].text is None and got[1].row == "row1"
