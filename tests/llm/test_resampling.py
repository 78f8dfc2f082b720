"""Importance resampling against its definition."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import frame, rows
from tidemark.llm import importance_resampling as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), [" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def bucket(feature):
    return crc32(feature.encode()) % 10000


def drawn(docs, items, percent=5, least=20):
    s, t = (Counter(bucket(f) for _, text in part for f in features(text)[1]) for part in (docs, items))
    S, T = s.total() + 10000, t.total() + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T)))
    out = []
    for i, text in docs:
        n, fs = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append((n, i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r))
    quota = percent * len(able) // 100
    ranked = [(*r[1:], k + 1 if k < quota else None) for k, r in enumerate(able)] + [(*r[1:], None) for r in out if r[0] < least]
    return sorted(ranked, key=str)


def table(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows(df)), key=str)


def made(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "Zebra", "é", "日本", "x1", "a_b", "q", "MIT", " ", "don't"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(None, docs[5][1]), (None, None), (7, ""), (8, None), (-1, "[]` {}\x7f"), (9, "long " * 50_000)]
    return docs + docs[:40] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed):
    docs, items = made(seed), [(1, "the zebra don't"), (2, None), (3, ""), (3, "MIT x1 q"), (None, "é 日本 é")]
    got = M.resample(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), percent=30)
    assert table(got) == drawn(docs, items, 30)
    assert any(r[-1] is not None for r in table(got)) and any(r[-1] is None for r in table(got))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 é.\x00　", max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_pieces_change_nothing(text, longest, size):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    want = Counter(crc32(" ".join(ws[i:i + n]).encode()) for n in range(1, longest + 1) for i in range(len(ws) - n + 1))
    got = list(M.checksums(text.encode(), longest, size))
    assert sum(n for n, _ in got) == len(ws)
    assert Counter(np.concatenate([c for _, c in got] or [[]]).tolist()) == want


def test_empty_tables(spark):
    docs, none = made(3), spark.createDataFrame([], "item_id long, text string")
    assert table(M.resample(frame(spark, docs), none)) == drawn(docs, [])
    assert M.resample(frame(spark, []), none).collect() == []


def test_many_equal_rows(spark):
    """A third of all rows equal: told apart by a number and ranked one after the other."""
    docs = [(i, f"word{i} " * 25) for i in range(40)] + [(77, "the zebra " * 15)] * 20
    items = [(1, "the zebra the zebra")]
    got = M.resample(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), percent=100)
    assert table(got) == drawn(docs, items, 100)
    ranks = sorted(r[-1] for r in table(got) if r[0] == 77)
    assert ranks == list(range(ranks[0], ranks[0] + 20))
