"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the ``WINDOW - SEED + 1`` word runs of length ``SEED`` in a window of
``WINDOW`` words, the one with the least hash (the leftmost on ties).  Equal windows choose equal
anchors at equal places, so every repeated window is found by joining documents on anchors, and only
one in about eight words sends a row.  An anchor stands for a run of neighbouring windows; their
words left and right of the anchor are its context.

* Occurrences of an anchor with the same context are extended in one step: all but the first are
  repeats as a whole.
* Where an anchor has several contexts, the first occurrence of each is extended window by window:
  a window is a repeat if the same words around the same anchor start earlier.

Overlapping repeats are merged into maximal ones, and their words removed.  Occurrences are never
paired with each other: each is compared with the first of its class, so a passage in a third of all
documents costs one row per occurrence.  Copies within one Arrow batch are settled there, so an anchor that is hot
with one context sends one row per batch to its shuffle partition, and one that is hot with many contexts is spread
over them.

Contexts are compared by a 64-bit hash that is independent of the anchor's.  Words are runs of
anything but space and the controls 9 to 13; a null or empty text, and one of fewer words than a
window, loses nothing.  "Earlier" goes by ``(doc_id, start)``, a null id before all others.  Rows
with the same id and start do not come before each other, so repeated rows get equal results.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.tables import by_batch, documents, keyed
from tidemark.session import stored

SEED, WINDOW = 6, 20
#: Seeds with several contexts that are broadcast, of 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_TABLE = W.byte_map(W.SPACES, lower=False)
#: A null id sorts before all others.
_NULL_ID = np.iinfo(np.int64).min
_SPOT = "g long, c long, doc_id long, rk long, lo int, hi int, settled boolean"
_PRIME = 0xD6E8FEB86659FD93 | 3
_PRIME_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the leftmost least of the next ``width`` hashes is."""
    at = np.arange(len(h))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        reach += step
    return at


def anchors(words: W.Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Anchors of a block: seed hash, context hash, text, first and last window, place of the seed."""
    n = len(words.doc) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, int, int, int, int))
    h0, h1 = words.hashes(0), words.hashes(1)
    grams = W.sequence_hashes(h0, seed)
    at = _least(grams, window - seed + 1)[:n]
    whole = W.inside(words, window)
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1] | (words.doc[1:n] != words.doc[:n - 1])
    runs = np.flatnonzero(new & whole)
    ends = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
    seat = at[runs]
    total = np.zeros(len(h1) + 1, np.uint64)
    np.cumsum(h1 * _powers(_PRIME, len(h1)), out=total[1:])
    context = (total[ends + window] - total[runs]) * _powers(_PRIME_INVERSE, len(h1) + 1)[runs]
    shape = ((seat - runs) * 64 + (seat - ends)).astype(np.uint64)
    context = W.mix(W.mix(context) + shape * np.uint64(_PRIME))
    return grams[seat], context, words.doc[runs], runs, ends, seat


def _spots(g, c, doc, rk, lo, hi) -> pa.RecordBatch:
    """Rows of one batch; a copy of an earlier row of the batch is settled and spread by its own key."""
    order = np.lexsort((lo, doc, c, g))
    g, c, doc, rk, lo, hi = (x[order] for x in (g, c, doc, rk, lo, hi))
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    tie = np.zeros(len(g), bool)
    heads = np.flatnonzero(~same)
    head = np.repeat(heads, np.diff(np.append(heads, len(g)))) if len(g) else heads
    tie = same & (doc == doc[head]) & (lo == lo[head])
    settled = same & ~tie
    g = np.where(settled, rk.view(np.uint64), g)
    ids = pa.array(doc, pa.int64(), mask=doc == _NULL_ID)
    return pa.RecordBatch.from_arrays(
        [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), ids, pa.array(rk),
         pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(settled)],
        names=["g", "c", "doc_id", "rk", "lo", "hi", "settled"])


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return (batch["doc_id"].fill_null(_NULL_ID).to_numpy(zero_copy_only=False),
            batch["rk"].to_numpy(zero_copy_only=False))


def _seeds(batch: pa.RecordBatch, window: int, seed: int) -> Iterator[pa.RecordBatch]:
    ids, keys = _ids(batch)
    parts = []
    for i, _, words in W.word_blocks(batch["text"], _TABLE):
        g, c, doc, lo, hi, _ = anchors(words, window, seed)
        parts.append((g, c, ids[i + doc], keys[i + doc], lo - words.first[doc], hi - words.first[doc]))
    yield _spots(*(np.concatenate(x) for x in zip(*parts)))


def _windows(batch: pa.RecordBatch, window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The windows of the listed runs, keyed by their words and by where their anchor lies in them."""
    ids, keys = _ids(batch)
    counts = batch["runs"].value_lengths().to_numpy(zero_copy_only=False)
    flat = batch["runs"].flatten()
    run_lo, run_hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    starts = np.append(0, np.cumsum(counts))
    parts = []
    for i, j, words in W.word_blocks(batch["text"], _TABLE):
        lo, hi = run_lo[starts[i]:starts[j]], run_hi[starts[i]:starts[j]]
        size = hi - lo + 1
        doc = np.repeat(np.repeat(np.arange(j - i), counts[i:j]), size)
        at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = words.first[doc] + at
        h0, h1 = words.hashes(0), words.hashes(1)
        seat = _least(W.sequence_hashes(h0, seed), window - seed + 1)
        g = W.sequence_hashes(h0, window)[place]
        c = W.sequence_hashes(h1, window, 1)[place] + (seat[place] - place).astype(np.uint64)
        parts.append((g, c, ids[i + doc], keys[i + doc], at, at))
    yield _spots(*(np.concatenate(x) for x in zip(*parts)))


def _kept(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    for i, j, raw, bounds in W.blocks(batch["text"]):
        data, n_words, n_removed, kept = raw.tobytes(), [], [], []
        for k in range(j - i):
            words = data[bounds[k]:bounds[k + 1]].split()
            runs = batch["runs"][i + k]
            keep = None
            if runs.is_valid:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, runs.values.field(0).to_numpy(), 1)
                np.add.at(edge, runs.values.field(1).to_numpy() + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
            n_words.append(len(words))
            n_removed.append(0 if keep is None else len(words) - int(keep.sum()))
            kept.append(b" ".join(words if keep is None else compress(words, keep.tolist())))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _ranked(spots: DataFrame) -> DataFrame:
    """Adds whether an occurrence is a repeat: not the first one of its seed with its context."""
    own = Window.partitionBy("g", "c").orderBy("doc_id", "lo")
    return (spots.repartition("g", "c").sortWithinPartitions("g", "c", "doc_id", "lo")
            .withColumn("repeat", F.col("settled") | (F.rank().over(own) > 1)))


def _several(spots: DataFrame) -> DataFrame:
    """The seeds with more than one context; each task sends one row per seed, however often it occurs."""
    own = spots.filter("not settled").groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    return own.filter("low <> high").select("g")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words left, joined by single spaces.

    Seeds are made twice, first for those with several contexts, then for the classes, which are dealt by seed
    and context: a phrase with ever other words around it lies in as many places as it has contexts.
    Texts are shuffled once by row key; both steps that need them again read that one shuffle.
    """
    docs = keyed(docs)
    runs = F.collect_list(F.struct("lo", "hi")).alias("runs")
    spots = by_batch(docs, partial(_seeds, window=window, seed=seed), _SPOT)
    several = stored(_several(spots), "several").withColumn("several", F.lit(True))
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    found = stored(_ranked(spots).join(several, "g", "left").filter("repeat or several").select("rk", "lo", "hi", "repeat"), "anchors")
    texts = docs.repartition("rk")
    open_runs = found.filter("not repeat").groupBy("rk").agg(runs)
    windows = by_batch(texts.join(open_runs.hint("shuffle_hash"), "rk").select("doc_id", "text", "rk", "runs"),
                       partial(_windows, window=window, seed=seed), _SPOT)
    again = _ranked(windows).filter("repeat").select("rk", "lo", "hi")
    marks = found.filter("repeat").select("rk", "lo", "hi").unionByName(again).groupBy("rk").agg(runs)
    return by_batch(texts.join(marks.hint("shuffle_hash"), "rk", "left").select("doc_id", "text", "runs"),
                    partial(_kept, window=window), "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left after removing passages that start earlier."""
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[]
                      ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS ws
  FROM documents),
s AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') AS win
      FROM w, LATERAL (SELECT unnest(generate_series(1, CAST(len(ws) AS BIGINT) - 19)) AS p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS q FROM r WHERE nth > 1),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM w),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.q) AS kept, count(*) AS n
      FROM a ANTI JOIN gone ON a.doc_id = gone.doc_id AND a.q = gone.q GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
