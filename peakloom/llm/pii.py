"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, address
schemes and words that announce an identifier. Each anchor is handed to a
local parser that grows it to both sides, validates what it found, and reports
a span in code points. Parsers of one kind never look behind their last match,
so each character is read a bounded number of times.

Base kinds are email, ip, card and phone. Added kinds are `login` (an address
with a user name in it) and `account` (an announced account or identity
number; those that look like an IBAN must have its check sum).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import by_slices, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Words that announce an account or identity number.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "pasaporte", "passeport", "reisepass")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
SPACED = re.compile(r"[0-9\x20-]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s/@?#]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"<>]*)?")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}\Z")
ANNOUNCED = re.compile(
    r"(?:\s{0,3}(?:number|num|no|nr|n[º°]|id)\b\.?)?[\s:#=]{1,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9][0-9-]{4,18}[0-9])"
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    anchors = ahocorasick.Automaton()
    for sign, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        anchors.add_word(sign, (kind, len(sign)))
    for digit in "0123456789":
        anchors.add_word(digit, ("digit", 1))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            anchors.add_word(form, ("cue", len(form)))
    anchors.make_automaton()
    return anchors


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the ISO 13616 check sum holds."""
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    domain = DOMAIN.match(text, at)
    start = at
    while start > after and text[start - 1] in LOCAL_PART:
        start -= 1
    return (start, domain.end()) if domain and start < at else None


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _card(text: str) -> bool:
    digits = [c for c in text if c not in " -"]
    return 13 <= len(digits) <= 19 and luhn("".join(digits))


def _login(text: str, at: int, after: int) -> tuple[int, int] | None:
    body = LOGIN.match(text, at)
    scheme = SCHEME.search(text, max(after, at - 21), at) if body else None
    return (scheme.start(), body.end()) if scheme else None


def _account(text: str, at: int, end: int) -> tuple[int, int] | None:
    if at and text[at - 1].isalnum():
        return None
    m = ANNOUNCED.match(text, end)
    if not m:
        return None
    start, stop = m.span(1)
    if m[1][0].isalpha():
        while not iban(text[start:stop]):  # a following word may have been taken in
            stop = text.rfind(" ", start, stop)
            if stop < 0:
                return None
        return start, stop
    return (start, stop) if sum(map(str.isdigit, m[1])) >= 6 else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """`(kind, start, end)` of all personal data, by kind as in KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    upto = dict.fromkeys(("email", "ip", "card", "phone", "account", "login"), 0)
    for last, (anchor, size) in _automaton().iter(text):
        at = last - size + 1
        if anchor == "digit":
            for kind, region, pattern, sound in (("ip", DOTTED, IP, _octets), ("card", SPACED, CARD, _card)):
                if at >= upto[kind]:
                    end = upto[kind] = region.match(text, at).end()
                    if end - at > 6:
                        found[kind] += [m.span() for m in pattern.finditer(text, at, end) if sound(m[0])]
            continue
        kind, span = "", None
        if anchor == "at":
            kind, span = "email", _email(text, at, upto["email"])
        elif anchor == "plus":
            m = PHONE.match(text, at)
            if m and at >= upto["phone"]:
                upto["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "scheme":
            kind, span = "login", _login(text, at, upto["login"])
        else:
            kind, span = "account", _account(text, at, last + 1)
        if span and span[0] >= upto[kind]:
            found[kind].append(span)
            upto[kind] = span[1]
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def redacted(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of the first of them."""
    out, reach = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= reach:
            out += [text[reach:start], f"[{kind.upper()}]"]
        reach = max(reach, end)
    return "".join([*out, text[reach:]])


def pii_spans(text: Column) -> Column:
    """All spans of each whole text; none for a null or empty text."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def found(column: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in texts_of(column)]
        return pa.array(rows, type=pa.list_(kind))

    @F.arrow_udf(SPANS)
    def spans(column: pa.Array) -> pa.Array:
        return by_slices(column, found)

    return spans(text)


def redact(text: Column) -> Column:
    """Each text with its personal data replaced; a null text stays null."""
    def replaced(column: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else redacted(t, find_spans(t)) for t in column.to_pylist()], type=pa.string()
        )

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        return by_slices(column, replaced)

    return clean(text)


def span_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """`kind:start:end` of the spans of some kinds, comma-joined in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `pii`: the spans. Every row is kept, repeated rows get equal spans; a column of that name is replaced."""
    return docs.withColumn("pii", pii_spans(F.col(text)))
