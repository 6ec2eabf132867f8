"""Pseudonyms: one to one, restorable, linked across notations, linear in a text's length."""

import datetime
import random
import time

import pytest

from corridor.llm import pii

KEY = b"k"


def new(text):
    return pii.rewrite(text, KEY)[0]


@pytest.mark.parametrize("write", [lambda d: d.strftime("%d/%m/%Y"), lambda d: d.strftime("%m/%d/%Y"), lambda d: d.strftime("%Y-%m-%d"), lambda d: f"{d.day}.{d.month}.{d.year}"])
def test_dates_of_ten_years(write):
    texts = [write(datetime.date(2015, 1, 1) + datetime.timedelta(i)) for i in range(3653)]
    found = [new(t) for t in texts]
    assert len(set(found)) == len(texts) and [pii.restore(f, KEY) for f in found] == texts


def test_notations_do_not_collide_and_are_linked():
    days = [datetime.date(2015, 1, 1) + datetime.timedelta(i) for i in range(3653)]
    texts = {t for d in days for t in (d.strftime("%d/%m/%Y"), d.strftime("%m/%d/%Y"), f"{d.day}/{d.month}/{d.year}")}
    assert len({new(t) for t in texts}) == len(texts)
    day, month, year = new("25/12/2024").split("/")
    assert new("12/25/2024") == f"{month}/{day}/{year}" and new("2024-12-25") == f"{year}-{month}-{day}"
    bare = lambda t: "".join(c for c in new(t) if c.isdigit())[-10:]
    assert bare("+1 (933) 555-7070") == bare("+1 933 555 7070") == bare("933-555-7070") == bare("+19335557070")
    assert new("+44 20 1234 5678").replace(" ", "") == new("+442012345678")
    assert new("John.Doe@Mail.com").lower() == new("john.doe@mail.com")
    assert pii.restore(new("John.Doe@Mail.com"), KEY) == "John.Doe@Mail.com"
    assert new("31/02/2024 0/1/2024 1.2.3") == "31/02/2024 0/1/2024 1.2.3"


def test_values_come_back():
    rnd = random.Random(3)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    for _ in range(400):
        for text in (f"+{rnd.choice([1, 44, 7, 380])} {digits(10)}", f"token={digits(rnd.randint(8, 900))}a", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.9.1"):
            assert pii.restore(new(text), KEY) == text


@pytest.mark.parametrize("text", ["a1" * 500_000, "1" * 1_000_000, "@" * 300_000, "a@" * 200_000, "password " * 60_000, "ab.c@d.com " * 30_000, "1-" * 200_000, "A9+/" * 250_000])
def test_long_texts(text):
    began = time.time()
    found = new(text)
    assert time.time() - began < 5 and len(found) == len(text)
