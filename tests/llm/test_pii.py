"""Anchored parsers against the plain patterns, added kinds, and redaction."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.llm import pii


def plain(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def check(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x // 10 + x % 10 for x in doubled) % 10 == 0

    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and check(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, *m.span()) for k, p, sound in rules for m in re.finditer(p, text) if sound(m[0])]


def base(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


CASES = ["a@b.c@d.e", "x@y", "@a.b", "a@@b.c", "me+x@host-1.co.uk, you@h.o", "1.2.3.4.5.6.7.8", "1.2..3.4.5.6", "256.1.1.1 0255.1.1.1",
         "4111 1111 1111 1111", "4111-1111-1111-1111 7", "41111111111111112", "+49 (30) 1234-5678.", "+1+2 345 678 901", "++1 23456789 ",
         "é@x.y 😀 a@b.cd", "", "9" * 5000 + ".1.1.1", "a.b" * 1000 + "@c.d", "1 2 3", "+12", "1.1.1.1@2.2.2.2"]


@pytest.mark.parametrize("text", CASES)
def test_base_kinds(text):
    assert base(text) == plain(text)


@given(st.text("a1.@+ -()25é4/:", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_kinds_on_any_text(text):
    assert base(text) == plain(text)


def test_added_kinds():
    def kinds(text):
        return [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k in ("account", "login")]

    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32 please") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("IBAN GB82WEST12345698765433") == []
    assert kinds("account no. 12345678, konto 99-88-77-66") == [("account", "12345678"), ("account", "99-88-77-66")]
    assert kinds("accounting 12345678; account of 12345678") == []
    assert kinds("ftp://bob:pw@host.org/x y") == [("login", "ftp://bob:pw@host.org/x")]
    assert kinds("https://host.org/a@b") == []


def test_redaction_merges_overlaps():
    text = "mail me@x.org or +49 170 1234567, ftp://me:pw@x.org/a."
    assert pii.redacted(text, pii.find_spans(text)) == "mail [EMAIL] or [PHONE], [LOGIN]"
    assert pii.find_spans(pii.redacted(text, pii.find_spans(text))) == []
    assert pii.redacted("abc", []) == "abc"


def test_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.cd", "x"), (3, "a@b.cd", "x"), (4, "w " * 100_000 + "a@b.cd", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    found = pii.with_spans(docs).select(
        "doc_id", pii.span_text(F.col("pii")).alias("s"), pii.count_kind(F.col("pii"), "email").alias("n"),
        pii.redact(F.col("text")).alias("clean")).collect()
    assert [(r.doc_id, r.s, r.n) for r in found] == [
        (1, "", 0), (2, "", 0), (3, "email:0:6", 1), (3, "email:0:6", 1), (4, "email:200000:200006", 1)]
    assert [r.clean for r in found][:3] == [None, "", "[EMAIL]"]
    assert pii.with_spans(docs.limit(0)).collect() == []
