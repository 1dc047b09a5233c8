"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus-signs, schemes, pairs of digits in the ways that
numbers and addresses write them, and identifier cues.  Each anchor goes to a local parser, which expands to the
boundaries and validates.  A parser only looks at what follows its last match, so all work is linear in the text.

Kinds ``email, ip, card, phone`` follow the contract's patterns, leftmost and without overlaps by kind; failing
matches are dropped without another try.  Beyond them the method finds ``url`` (after a scheme), ``secret``
(a value given to a token, key or password), ``iban`` (checked by its remainder of 97) and ``ssn``
(after its cue).

Defined results: a NULL or empty text has no spans; repeated rows give a row each; a NULL identifier is carried along;
texts of any length are handled alike; an empty table gives no rows; other columns are ignored.  Places are code
points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "iban", "ssn")

_DIGITS = "0123456789"
_CUES = {"secret": ("token", "api_key", "apikey", "api key", "password", "passwd", "secret"), "iban": ("iban",), "ssn": ("ssn", "social security number")}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"""[^\s<>"'`|\\^{}]+""")
_SECRET = re.compile(r"""["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_\-./+=]{16,})""")
_IBAN = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[\s:#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")

_AUTOMATON: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """This worker's automaton over all anchors."""
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        found: dict[str, set[str]] = {"@": {"email"}, "+": {"phone"}, "://": {"url"}}
        for a in _DIGITS:
            for b in _DIGITS:
                for between, kind in (("", "card"), (" ", "card"), ("-", "card"), (".", "ip")):
                    found.setdefault(a + between + b, set()).add(kind)
        for kind, cues in _CUES.items():
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                    found.setdefault(form, set()).add(kind)
        for anchor, kinds in found.items():
            (kind,) = kinds
            made.add_word(anchor, (kind, len(anchor)))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = ord(x) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _iban(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` in the order of kinds, then of places."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended
    for last, (kind, width) in automaton().iter(text):
        at = last - width + 1
        floor = done[kind]
        if kind == "email":
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done[kind] = m.end()
                spans[kind].append((start, m.end()))
        elif at < floor:
            continue
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                done[kind] = m.end()
                if 9 <= sum(x in _DIGITS for x in m[0]) <= 15:
                    spans[kind].append(m.span())
        elif kind == "ip":
            while at > floor and text[at - 1] in _DIGITS:
                at -= 1
            if m := _IP.match(text, at):
                done[kind] = m.end()
                if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split(".")):
                    spans[kind].append(m.span())
        elif kind == "card":
            while at > floor:
                if text[at - 1] in _DIGITS:
                    at -= 1
                elif text[at - 1] in " -" and at - 2 >= floor and text[at - 2] in _DIGITS:
                    at -= 2
                else:
                    break
            m = _CARD.match(text, at)
            done[kind] = m.end()
            if m.end() - at < 40 and 13 <= len(digits := "".join(x for x in m[0] if x in _DIGITS)) <= 19 and luhn(digits):
                spans[kind].append(m.span())
        elif kind == "url":
            start = at
            while start > floor and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _URL.match(text, at + 3)):
                end = m.end()
                while end > at + 3 and text[end - 1] in ".,;:!?)]":
                    end -= 1
                done[kind] = m.end()
                if end > at + 3:
                    spans[kind].append((start, end))
        else:
            if (m := {"secret": _SECRET, "iban": _IBAN, "ssn": _SSN}[kind].match(text, last + 1)) and (kind != "iban" or _iban(m[1])):
                done[kind] = m.end(1)
                spans[kind].append(m.span(1))
    return [(kind, a, b) for kind in KINDS for a, b in spans[kind]]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of ``(kind, start, end)``, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(x.as_py() or "")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``find_personal_data`` found."""
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    joined = lambda x: f"array_join(transform({x}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS),
        F.expr(f"sha2({joined(f'filter(spans, s -> s.kind in ({base}))')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"),
    )
