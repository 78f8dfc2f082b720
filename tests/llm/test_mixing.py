"""The mix of sources: targets, schedule and pieces against their definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan
from tidemark.llm import source_mixing as M

SCHEMA = "doc_id long, text string, source string, size string, s string, at int, row int, block string"


def wanted_targets(size, share=1.5, epochs=2, weights=(5, 2, 1)):
    """By the words of the contract: cut what is above, reshare the excess, until none is."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out = share * sum(size.values()), {}
    open_ = list(order)
    while open_:
        rest, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > epochs * size[s]]
        if not over:
            return {**out, **{s: rest * weight[s] / w for s in open_}}
        out.update({s: float(epochs * size[s]) for s in over})
        open_ = [s for s in open_ if s not in out]
    return out


def wanted(docs):
    """Words taken of each row: the source's stream from its start, as often as its target reaches."""
    rows = [(i, src, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, src in docs]
    size = Counter()
    for _, src, n in rows:
        size[src] += n
    target, out = wanted_targets(size), []
    for src in size:
        key = lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], r[0] is not None, r[0] or 0, r[2])
        at, quota = 0, min(2 * size[src], int(target[src] + 0.5))
        for i, _, n in sorted((r for r in rows if r[1] == src), key=key):
            taken = quota // size[src] * n + max(0, min(n, quota % size[src] - at)) if n else 0
            out.append((i, n, size[src], round(target[src], 6), taken))
            at += n
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", "y", 1, 2, "z") for d in docs], SCHEMA)


def taken(pieces):
    """As the query sums them up, from collected pieces."""
    out = Counter()
    for r in pieces:
        out[r.doc_id, r.size, r.source_size, round(r.target, 6), r.s, r.at] += r.n_words or 0
    empty = [(r.doc_id, 0, r.source_size, round(r.target, 6), 0) for r in pieces if r.size == 0]
    return sorted([(*k[:4], n) for k, n in out.items() if k[1]] + empty, key=str)


def made(seed, n=200, sources=7):
    rng = random.Random(seed)
    names = ["a", "B", "é", "\U0001F600", "￿", "", None, *(f"s{k}" for k in range(sources))]
    docs = [(i, "w " * int(rng.expovariate(1 / 30)), rng.choice(names) if rng.random() < 0.6 else "hot") for i in range(n)]
    docs += [(None, "null id", "a"), (None, None, "a"), (5, "", None), (6, None, "only empty"), (7, "long " * 30_000, "long")]
    return docs + docs[:30] * 2


@pytest.mark.parametrize("seed, block", [(1, 1000), (2, 7)])
def test_equals_the_definition(spark, seed, block):
    docs = made(seed)
    assert taken(M.mixed(frame(spark, docs), block=block).collect()) == wanted(docs)


def test_the_query_sums_the_pieces(spark, sf):
    pieces = M.mixed(M.documents(spark, sf)).collect()
    got = M.op13_source_mixing(spark, sf).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == taken(pieces)


def test_pieces_and_slots_agree(spark):
    """Every slot is filled by adjoining pieces, and no word is taken twice in an epoch."""
    docs = made(3)
    sizes = M.stored(frame(spark, docs).select("doc_id", "source", F.regexp_count("text", F.lit(M.WORD)).cast("long").alias("size")).fillna(0, "size"))
    mix = M.schedule(spark, M.targets(sizes), 11)
    slots = {r.slot: r for r in mix.slots.collect()}
    filled, words = Counter(), defaultdict(Counter)
    for r in M.mixed(frame(spark, docs), block=11).filter("slot IS NOT NULL").collect():
        filled[r.slot] += r.n_words
        assert 0 <= r.first and r.first + r.n_words <= r.size and slots[r.slot].s == r.s
        words[r.s, slots[r.slot].epoch].update(range(r.at + r.first, r.at + r.first + r.n_words))
    assert filled == {k: r.n_words for k, r in slots.items() if r.n_words}
    assert all(n == 1 for each in words.values() for n in each.values())


def test_every_stretch_holds_the_sources_in_proportion(spark):
    """Any beginning of the schedule is within a few slots of the targets, whatever their ratio."""
    sizes = spark.createDataFrame([(f"s{k:02}", 1000 * (k + 1) ** 2) for k in range(12)], "source string, size long")
    mix = M.schedule(spark, M.targets(sizes), 100)
    need = {r.s: r.n_slots for r in mix.sources.collect()}
    slots = sorted((r.slot, r.s) for r in mix.slots.collect())
    assert Counter(s for _, s in slots) == {s: n for s, n in need.items() if n}
    assert len({k for k, _ in slots}) == len(slots)
    total, so_far, worst = sum(need.values()), Counter(), 0
    for n, (_, s) in enumerate(slots, 1):
        so_far[s] += 1
        worst = max(worst, *(abs(so_far[t] - n * need[t] / total) for t in need))
    assert total > 800 and worst < 6, worst


def test_many_sources_of_unequal_size(spark):
    """Thousands of sources, most of them tiny, one with a third of all words."""
    sizes = [("hot", 500_000)] + [(f"s{k}", 1 + k % 50) for k in range(3000)] + [("none", 0)]
    df = spark.createDataFrame(sizes, "source string, size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    want = wanted_targets(dict(sizes))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    mix = M.schedule(spark, M.targets(df), 1000)
    words = {r.s: r.n for r in mix.slots.groupBy("s").agg(F.sum("n_words").alias("n")).collect()}
    for r in mix.sources.collect():
        assert words.get(r.s, 0) == r.quota and abs(r.quota - r.target) <= 0.5


def test_reruns_agree_whatever_the_layout(spark):
    docs = made(4)
    once = taken(M.mixed(frame(spark, docs)).collect())
    random.Random(9).shuffle(docs)
    assert taken(M.mixed(frame(spark, docs).repartition(13)).collect()) == once


def test_empty_tables(spark):
    assert M.mixed(frame(spark, [])).collect() == []
    nothing = [(1, None, "a"), (2, " ", None), (2, " ", None)]
    assert taken(M.mixed(frame(spark, nothing)).collect()) == sorted([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


def test_a_third_of_all_rows_is_cut(spark):
    """Equal rows of one source lie in several runs."""
    docs = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"),
                                      F.when(F.col("id") < 10_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sizes = docs.withColumn("row", F.monotonically_increasing_id()).select("source", "doc_id", "row")
        runs = M.sorted_runs(sizes, ["source", "doc_id", "row"])
        assert runs.filter("source = 'hot'").select("run").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = M.mixed(docs, block=100).groupBy().agg(F.sum("n_words")).first()[0]
    assert abs(got - 90_000) <= 51


def test_native(spark, sf):
    text = plan(M.op13_source_mixing(spark, sf))
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
