"""Periodic runs against their definition."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from tests.llm.helpers import frame, rows
from tidemark.llm import periodic_runs as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, shortest=6, exponent=4):
    """Start, length and period: maximal stretches of every period, none with a smaller period."""
    n, out = len(words), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(shortest, exponent * p):
                part = words[i:j + p]
                if not any(all(part[x] == part[x + d] for x in range(len(part) - d)) for d in range(1, p)):
                    out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def of_texts(texts, **parameters):
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0] + [len(t) for t in texts])
    out = [[] for _ in texts]
    for s, n, p in zip(*M.find(M._numbers([[w.encode() for w in t] for t in texts]), doc, **parameters)):
        out[doc[s]].append((int(s - first[doc[s]]), int(n), int(p)))
    return out


#: Blocks repeated up to nine times with some words between.
TEXT = st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=7), st.integers(1, 9)), max_size=5) \
    .map(lambda parts: list("".join(b * k for b, k in parts)))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_equals_the_definition(texts):
    assert of_texts(texts) == [all_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60).map(list), max_size=3), st.integers(1, 9), st.integers(4, 6))
def test_other_thresholds(texts, shortest, exponent):
    assert of_texts(texts, shortest=shortest, exponent=exponent) == [all_runs(t, shortest, exponent) for t in texts]


def test_exponents_below_four_are_refused():
    with pytest.raises(ValueError):
        M.find(np.zeros(3, int), np.zeros(3, int), exponent=3)


@pytest.mark.parametrize("period", [1, 2, 3, 7, 8, 9, 31, 32, 33, 100])
def test_long_periods_and_their_edges(period):
    rng = random.Random(period)
    head, tail = ([f"x{rng.randrange(5)}" for _ in range(40)] for _ in range(2))
    block = [f"w{k}" for k in range(period)]
    for extra in (0, 1, period - 1):
        text = head + (block * 6)[:4 * period + extra] + tail
        assert of_texts([text, text[:-1]]) == [all_runs(text), all_runs(text[:-1])]
        if 4 * period + extra >= 6:
            assert any(p == period for *_, p in all_runs(text))


def made(seed):
    rng = random.Random(seed)
    out = [(None, "a a a a a a a"), (None, None), (1, ""), (2, None), (3, " \t\x0b\n"), (4, "é日 é日 é日 é日 é日 é日"),
           (5, "a b a b a b a b"), (6, "A a A a A a A a"), (7, "x " * 5), (8, "a b " * 20_000), (9, "p q r s t " * 4 + "p")]
    for i in range(10, 150):
        words = []
        for _ in range(rng.randrange(6)):
            words += [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))] * rng.choice([1, 1, 2, 4, 5, 9])
        out.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return out + out[:30]


def test_table(spark):
    docs = made(1)
    want = []
    for i, text in docs:
        ws = WORD.findall(text or "")
        found = [(0, 40_000, 2)] if i == 8 else all_runs(ws)
        want.append((i, len(ws), found, collapsed(ws, found)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
           for r in rows(M.runs(frame(spark, docs)))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert M.runs(frame(spark, [])).collect() == []


def test_planted_periods():
    words = [str(k).encode() for k in range(50)]
    assert M.planted(None, words) == words
    hit = next(i for i in range(100) if M.crc32(str(i).encode()) % 10 == 0)
    g = M.crc32(str(hit).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert M.planted(hit, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert M.planted(hit, []) == []
