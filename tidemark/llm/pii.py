"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, schemes and cue
words.  Around each anchor a local parser expands to the whole candidate and validates it; it looks
no further than the candidate reaches, and never behind the end of the last match of its kind, so
the work grows with the text.

Base kinds: ``email``, ``ip`` (parts to 255), ``card`` (14 to 19 digits, Luhn), ``phone`` (10 to 15
digits).  Added kinds: ``url`` (a scheme and what follows), ``iban`` (checksum 97) and ``account``
(a cue word such as "account no" and 6 to 18 digits).  Matches that fail are dropped and not retried.

Spans count code points.  A null or empty text has none.  Repeated rows get equal results; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.spans import Span, span_columns
from tidemark.llm.tables import by_batch, documents

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[^\s<>\"'`{}|\\^]*[^\s<>\"'`{}|\\^.,;:!?)\]]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|number|nr)\b\.?)?[\x20:#=]{1,3}([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])", re.I)
_SCHEMES = ("http://", "https://", "ftp://")
_CUES = ("iban", "account", "acct")


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors; the value of each is its kind and length."""
    out = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in "0123456789"), *((s, "url") for s in _SCHEMES),
                       *((w, c) for c in _CUES for w in (c, c.upper(), c.capitalize()))]:
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a decimal number is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 2 or len(part) == 3 and part <= "255"


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text."""
    base: list[Span] = []
    more: list[Span] = []
    end = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton().iter(text):
        at = last - length + 1
        if kind == "0":
            if at and text[at - 1] in _DIGITS:
                continue
            if at >= end["ip"] and (m := _IP.match(text, at)):
                end["ip"] = m.end()
                if all(map(small, m.groups())):
                    base.append(("ip", at, m.end()))
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    base.append(("card", at, m.end()))
        elif kind == "@":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _EMAIL.match(text, start)):
                end["email"] = m.end()
                base.append(("email", start, m.end()))
        elif kind == "+":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    base.append(("phone", at, m.end()))
        elif kind == "url":
            if at >= end["url"] and (m := _URL.match(text, at)):
                end["url"] = m.end()
                more.append(("url", at, m.end()))
        elif kind == "iban":
            at = last + 1
            while at < len(text) and at <= last + 3 and text[at] in " :=#":
                at += 1
            if at >= end["iban"] and (m := _IBAN.match(text, at)) and iban(m[0]):
                end["iban"] = m.end()
                more.append(("iban", at, m.end()))
        elif (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= end["account"]:
            end["account"] = m.end(1)
            more.append(("account", *m.span(1)))
    return base, more


def mask(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    base, more = find(text)
    out, at = [], 0
    for kind, a, b in sorted([*base, *more], key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; ``n_chars``, if there, counts the new text."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [None if t is None else mask(t) for t in batch["text"].to_pylist()]
        for name, kind, values in (("text", pa.string(), texts),
                                   ("n_chars", pa.int64(), [None if t is None else len(t) for t in texts])):
            if name in batch.schema.names:
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, name, pa.array(values, kind).cast(batch.schema.field(at).type))
        yield batch
    return by_batch(docs, work, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return span_columns(documents(spark, sf_dir), find, BASE, KINDS)
