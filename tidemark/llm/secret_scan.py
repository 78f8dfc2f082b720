"""Secret scan by assignment-aware lexing.

A text is lexed into pairs of a name and what is assigned to it: quoted or bare literals, names, and
sums of them, in source code (``name = "x"``, ``name := x``, ``name <- "x"``, ``name: type = x``, ``table["name"] = "x"``,
``(name, other) = ("x", "y")``), JSON and YAML (``"name": "x"``, lists and blocks below a name), XML
(``key="name" value="x"``), settings (``NAME=x``) and calls (``define("NAME", "x")``).  The right side may stand in
brackets or on the next line.  Strings may have a prefix, triple quotes or backticks, and adjoining strings are a sum.
Of a call on the right side the last string counts, unless it is all that a function that looks something up is given
(``getenv("X")``).  A bare word without digits is the name of something, not a literal, but in settings (no blanks at the sign) and
YAML, to the end of the line.
Constants are propagated in text order: a name that was assigned literals
stands for them wherever it is assigned on.  Each literal is scored by the most sensitive name it
reaches and by the look (length, variety, entropy) of itself or of a sum it is a piece of; literals of
at least ``THRESHOLD`` are reported as kind ``literal``, the pieces of a sum one by one.  The three base patterns are reported besides, whatever the score.

Bounds of the lexer: names have up to 128 characters and types 64 to 96; a folded constant is given up beyond 256
distinct characters, and is no placeholder beyond 1,000.  A literal with blanks scores 0.

Spans count code points; equal literals at different places are spans each.  A null or empty text has none.  A very
long text is lexed as a whole in linear time.  Repeated rows get equal results; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.spans import Span, span_columns
from tidemark.llm.tables import documents

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")
#: Least score of a literal that is reported.
THRESHOLD = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("password", "passwd", "secret", "token", "api")

#: A declared type, and what an assignment sign is that is no comparison.
_TYPE = (r"""[&*]{0,2}(?:'[a-z_]{1,32}[ \t]{1,4})?(?:(?:mut|dyn|const)[ \t]{1,4})?[A-Za-z_][A-Za-z0-9_.:]{0,63}"""
         r"""(?:[\[<][^\n=;"`]{0,96}?[\]>]{1,4})?[?!*]{0,2}(?:[ \t]{0,4}\|[ \t]{0,4}[A-Za-z_][A-Za-z0-9_.\[\]]{0,63}){0,4}""")
_EQUALS = r"=(?![=~>])"
#: Before a string: letters, signs, or the marks of a raw string.
_PREFIX = r"(?:[bBrRfFuUlL]{1,2}|[@$]{1,2})?"
#: A name, perhaps quoted, an assignment sign after an optional type, and where the right side begins.
#: With a type, the right side is a string, or a name set off by blanks.
_PAIR = re.compile(
    r"""(?P<q>["']?)(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]{0,127})(?P=q)(?:(?<=["'])\])?+[ \t]*+(?P<sign>:=|=>|<-(?=[ \t]*+["'])|"""
    + r"""(?<=["']),(?=[ \t]*+["'`])|""" + _EQUALS
    + r"""|(?<=[ \t])(?:string|\[\]byte)[ \t]*+""" + _EQUALS
    + r"""|\??:[ \t]*+(?P<type>""" + _TYPE + r""")(?:[ \t]*+""" + _EQUALS + r"""(?=[ \t]*+(?:r\#{1,8}|""" + _PREFIX + r""")["'`])"""
    + r"""|[ \t]++""" + _EQUALS + r"""(?=[ \t]++[A-Za-z_$]))|:(?![:/]))[ \t]*+""")
_STRING = re.compile(
    _PREFIX + r"""(?:\"{3}(?P<three>(?:[^\\]|\\.)*?)\"{3}|'{3}(?P<single>(?:[^\\]|\\.)*?)'{3}|`(?P<tick>(?:[^`\\]|\\.)*+)`"""
    + r"""|"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<one>(?:[^'\\\n]|\\.)*+)')""", re.DOTALL)
#: Raw strings end at a quote with as many marks.
_RAW = re.compile(r"r(#{1,8})\"")
#: Types that are no names of constants.
_TYPES = {"str", "string", "bytes", "char", "text", "any", "object", "final", "const", "int", "float", "bool", "boolean", "number"}
_BARE = re.compile(r"[A-Za-z0-9+/_.=$-]+")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
#: Brackets before the right side; a line that ends with an equals sign goes on with a string.
_OPEN = re.compile(r"(?:[(\[][ \t\r\n]*+){1,2}(?=[^)\]])")
_NEXT_LINE = re.compile(r"""\r?\n[ \t]*+(?=[bBrRfFuUlL@$]{0,2}["'`])""")
#: Between strings that make one: blanks, in brackets also line ends.
_BLANKS, _SPACE = re.compile(r"[ \t]*+"), re.compile(r"[ \t\r\n]*+")
#: What a call is given, and names of functions that look something up.
_NEW, _COMMA = re.compile(r"new[ \t]++(?=[A-Za-z_])"), re.compile(r"[ \t\r\n]*+,[ \t\r\n]*+")
_LOOKS_UP = re.compile(r"(?:get|env|read|load|input|prompt|lookup|fetch|find|ask|pop|var|param|config)", re.I)
#: Items of a YAML list, and the lines of a block.
_ITEM, _BLOCK = re.compile(r"[ \t]*+\r?\n[ \t]*+-[ \t]++"), re.compile(r"[|>][+-]?[ \t]*+\r?\n[ \t]++")
#: Names to which as many right sides are assigned.
_TUPLE = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]{0,127}(?:[ \t]*+,[ \t]*+[A-Za-z_$][A-Za-z0-9_.$]{0,127}){1,15}+[ \t]*+\)?[ \t]*+"
                    + _EQUALS + r"[ \t]*+[(\[]?[ \t]*+")
_WORD = re.compile(r"[A-Za-z_$.-]+\Z")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]{0,127}\Z")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How much a part of a name says about what it holds.
_WEIGHT = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
           "credential": 0.9, "credentials": 0.9, "private": 0.7, "auth": 0.7, "bearer": 0.8, "key": 0.5, "salt": 0.5,
           "signature": 0.5}
_PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|none|null|nil|true|false|changeme|example|todo)\Z", re.I)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that pass its test."""
    out: list[Span] = []
    low = text.lower()
    if any(cue in low for cue in _CUES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    """0 to 1: how likely the name holds a secret, by its parts."""
    parts = [p.lower() for p in _PART.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((_WEIGHT.get(p, _WEIGHT.get(p.removesuffix("s"), 0.0)) for p in parts + pairs), default=0.0)


def look(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret by its length, entropy and kinds of characters."""
    return 0.0 if _PLACEHOLDER.match(literal) else counted_look(Counter(literal))


def counted_look(chars: Counter[str]) -> float:
    """The look of what is made of these characters and is no placeholder."""
    n = sum(chars.values())
    if n < 6 or " " in chars:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
    kinds = sum(any(f(c) for c in chars) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, entropy / 4) * (0.6 + 0.2 * min(kinds, 2)) * min(1.0, 0.5 + min(n, 12) / 24)


Term = tuple[int, int] | str
#: A folded constant: its characters, and its text while that is short; None if it is not known.
Folded = tuple[Counter[str], str | None] | None
#: Characters of folded text that are kept to see placeholders, and distinct characters of a folded constant.
_KEPT, _DISTINCT = 1_000, 256


def folded(values: list[Folded]) -> Folded:
    """The sum of constants; one constant is itself."""
    if len(values) == 1:
        return values[0]
    chars: Counter[str] = Counter()
    text: str | None = ""
    for value in values:
        if value is None:
            return None
        chars.update(value[0])
        text = None if text is None or value[1] is None or len(text) + len(value[1]) > _KEPT else text + value[1]
        if len(chars) > _DISTINCT:
            return None
    return (chars, text) if values else None


Terms = list[tuple[Term, tuple[int, int] | None]]


def string_at(text: str, at: int, open_marks: set[str]) -> tuple[tuple[int, int], int] | None:
    """The span of the string that begins at a place, and where it ends with its quotes."""
    if (raw := _RAW.match(text, at)) and raw[1] not in open_marks:
        end = text.find(f'"{raw[1]}', raw.end())
        if end >= 0:
            return (raw.end(), end), end + 1 + len(raw[1])
        open_marks.add(raw[1])  # none ends from here on, so the rest is searched once
    if not (s := _STRING.match(text, at)):
        return None
    k = s.lastgroup
    a, b = s.span(k)
    if k in ("three", "single", "tick"):  # text in such quotes may stand on lines of its own
        body = text[a:b]
        a, b = a + len(body) - len(body.lstrip()), b - len(body) + len(body.rstrip())
    return (a, max(a, b)), s.end()


def call_at(text: str, name: str, at: int, open_marks: set[str]) -> tuple[tuple[int, int] | None, int]:
    """Of a call whose first argument begins at a place, the string that it stands for, and where its strings end."""
    found: list[tuple[int, int]] = []
    at = _SPACE.match(text, at).end()
    while s := string_at(text, at, open_marks):
        found.append(s[0])
        at = s[1]
        if not (comma := _COMMA.match(text, at)):
            break
        at = comma.end()
    if not found or len(found) == 1 and _LOOKS_UP.search(name.rsplit(".", 1)[-1]):
        return None, at
    return found[-1], at


def tuples(text: str) -> list[tuple[int, list[tuple[str, Terms]]]]:
    """Names in a row with as many strings assigned to them, and where the last name stands."""
    out, open_marks = [], set()
    for m in _TUPLE.finditer(text):
        names = re.findall(r"[A-Za-z_$][A-Za-z0-9_.$]*", m[0])
        at, found = m.end(), []
        while s := string_at(text, at, open_marks):
            found.append(s[0])
            at = s[1]
            if not (comma := _COMMA.match(text, at)):
                break
            at = comma.end()
        if len(found) == len(names):
            out.append((at, [(n, [(span, None)]) for n, span in zip(names, found)]))
    return out


def yaml_lines(text: str, at: int, open_marks: set[str]) -> tuple[Terms, int]:
    """Items of a list, or the first line of a block, below a name."""
    terms: Terms = []
    if block := _BLOCK.match(text, at):
        end = text.find("\n", block.end())
        end = len(text) if end < 0 else end
        return [((block.end(), max(block.end(), block.end() + len(text[block.end():end].rstrip()))), None)], end
    while item := _ITEM.match(text, at):
        if s := string_at(text, item.end(), open_marks):
            terms.append((s[0], None))
            at = s[1]
        elif (w := _BARE.match(text, item.end())) and not text.startswith(":", w.end()):
            terms.append((w.span(), None))
            at = w.end()
        else:
            break
    return terms, at


def pairs(text: str) -> Iterator[tuple[str, Terms]]:
    """Names in text order with the terms assigned to them: spans of strings, or bare words and where they stand."""
    at, open_marks = 0, set()
    rows = tuples(text) if "," in text and "=" in text else []
    rows.reverse()
    marked: tuple[int, str] | None = None
    while m := _PAIR.search(text, at):
        at, terms, bare, start = m.end(), [], False, m.end()
        if rows and rows[-1][0] > m.start() and at <= rows[-1][0]:
            end, found = rows.pop()  # the last name of a row has the sign
            yield from found
            at = max(at, end)
            continue
        while rows and rows[-1][0] <= m.start():
            yield from rows.pop()[1]
        sign = m["sign"] or ""
        if m["q"] and sign == "," and not text[:m.start()].endswith("(") and not text[max(0, m.start() - 8):m.start()].rstrip().endswith("("):
            at = m.end("name") + 1  # strings in a row, not what a call is given
            continue
        if sign == ":" and (lines := yaml_lines(text, at, open_marks))[0]:
            for term in lines[0]:
                yield m["name"], [term]
            at = lines[1]
            continue
        if opened := _OPEN.match(text, at):
            at = opened.end()
        elif sign.endswith("=") and (below := _NEXT_LINE.match(text, at)):
            at = below.end()
        blanks = _SPACE if opened else _BLANKS
        while True:
            if new := _NEW.match(text, at):
                at = new.end()
            if s := string_at(text, at, open_marks):
                terms.append((s[0], None))
                bare, at = False, s[1]
                after = blanks.match(text, at).end()
                if text[after:after + 1] in ('"', "'") and after > at and _STRING.match(text, after):
                    at = after
                    continue
            elif s := _BARE.match(text, at):
                if text.startswith("(", s.end()) and _NAME.match(s[0]):
                    literal, end = call_at(text, s[0], s.end() + 1, open_marks)
                    if literal:
                        terms.append((literal, None))
                    elif not terms:
                        terms.append((s[0], (s.end(), s.end())))
                    else:
                        terms.append((s[0], s.span()))
                    bare, at = False, end
                    break
                terms.append((s[0] if _NAME.match(s[0]) else s.span(), s.span()))
                bare, at, start = True, s.end(), s.start()
            else:
                break
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if bare and len(terms) == 1 and isinstance(terms[0][0], str) and _WORD.match(terms[0][0]):
            blank = sign != ":" and (m[0][-1] in " \t" or m[0][-1 - len(sign)] in " \t")
            if blank or text[at:at + 1] not in ("", "\n", "\r", " ", "\t"):
                terms = [(terms[0][0], (at, at))]  # a name: it stands for what it was assigned, and for nothing else
        if marked and m["name"].lower() == "value" and not text[marked[0]:m.start()].strip(" \t"):
            yield marked[1], terms  # <add key="name" value="x"/>
        one = terms[0][0] if len(terms) == 1 and not bare and isinstance(terms[0][0], tuple) else None
        marked = (at, text[one[0]:one[1]]) if one and m["name"].lower() in ("key", "name", "id") else None
        yield m["name"], terms
        if m["type"] and _NAME.match(m["type"]) and m["type"].lower() not in _TYPES:
            yield m["type"], terms  # `note: name = "x"` is no type
        if bare:
            at = max(m.end(), start)  # a bare word may itself be the next name
    while rows:
        yield from rows.pop()[1]


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name and look like secrets.

    One pass forward splits the right sides into literals and names that have been assigned before, and
    folds them; one pass back carries the weight of each name, and the score of what it was folded into,
    to what was assigned to it last.
    """
    if "=" not in text and ":" not in text:
        return []
    assigned: dict[str, Folded] = {}
    steps: list[tuple[str, list[Term], Folded]] = []
    for name, terms in pairs(text):
        parts: list[Term] = []
        values: list[Folded] = []
        for term, place in terms:
            if isinstance(term, str) and term in assigned:
                parts.append(term)
                values.append(assigned[term])
                continue
            a, b = parts_span = term if place is None else place
            parts.append(parts_span)
            unknown = place is not None and len(terms) > 1  # a bare word of a sum may stand for anything
            values.append(None if unknown else (Counter(text[a:b]), text[a:b] if b - a <= _KEPT else None))
        steps.append((name, parts, folded(values)))
        assigned[name] = steps[-1][2]
    weight: dict[str, tuple[float, float]] = {}
    score: dict[tuple[int, int], float] = {}
    for name, parts, value in reversed(steps):
        own, whole = weight.pop(name, (0.0, 0.0))
        own = max(sensitivity(name), own)
        if not own:
            continue
        if len(parts) > 1 and value and not (value[1] and _PLACEHOLDER.match(value[1])):
            whole = max(whole, own * counted_look(value[0]))
        for part in parts:
            if isinstance(part, str):
                a, b = weight.get(part, (0.0, 0.0))
                weight[part] = (max(a, own), max(b, whole))
            else:
                score[part] = max(score.get(part, 0.0), whole, own * look(text[part[0]:part[1]]))
    return [("literal", a, b) for (a, b), best in sorted(score.items()) if a < b and best >= THRESHOLD]


def find(text: str) -> tuple[list[Span], list[Span]]:
    return base_spans(text), literal_spans(text)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return span_columns(documents(spark, sf_dir), find, BASE, KINDS)
