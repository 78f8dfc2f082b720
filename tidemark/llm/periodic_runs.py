"""Periodic runs of words by the dictionary of basic factors.

A factor is a stretch of words, a basic one has a power of two of them.  The dictionary names the
basic factors of one length after the other: equal factors of one text have equal names, and a factor
of twice the length is named by the pair of names of its halves.

For each length ``L`` every factor looks for its successor, the next equal one.  Where both lie
within twice the length, that is at most ``L`` apart, occurrences form arithmetic progressions, and
the step of a progression of three is proposed as a period.  It is extended over all neighbouring starts
with the same step ``p``: the step cannot go on where a neighbouring word breaks the period, so the
stretch from the first start to the end of the last factor is maximal, and since ``L >= p`` no
smaller period can hold in it (the factor would come again sooner).  A run of four or more periods has
such progressions at the first length that reaches its period; it may be found again at greater
lengths and is kept once.

Only factors that come again in their text are carried to the next length, and texts too short for
a longer period are left, so ordinary text costs two or three sorts of its words.  All texts of a block
of a megabyte (or one text) are sorted together; memory is about 150 bytes per byte of the longest text.

Words are runs of anything but space and the controls 9 to 13, compared as they are.  A null or empty
text has no words and no runs.  Rows are judged each by itself, so ties and repeated rows need no
rule; an empty table gives an empty result, and extra columns are ignored.  A null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.tables import by_batch, documents, keyed

SHORTEST, EXPONENT = 6, 4
#: The words of a text, from its id and its words as they stand.
Edit = Callable[[int | None, list[bytes]], list[bytes]]


def progressions(at: np.ndarray, names: np.ndarray, length: int, n: int) -> tuple[np.ndarray, ...]:
    """Start, length and period of the stretches that progressions of equal factors span.

    ``at`` holds ascending places below ``n`` and ``names`` the names of the factors there.
    Also tells which of the factors come again.
    """
    order = np.argsort(names, kind="stable")
    equal = names[order[1:]] == names[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    step = np.zeros(n + 1, np.int64)
    apart = at[order[1:]] - at[order[:-1]]
    near = equal & (apart <= length)
    step[at[order[:-1][near]]] = apart[near]
    moved = np.flatnonzero(step[1:] != step[:-1]) + 1
    first = np.append(0, moved)
    last = np.append(moved, n + 1) - 1
    first, last = (x[step[first] > 0] for x in (first, last))
    if not len(first):
        return first, first, first, again
    place = np.arange(n + 1)
    third = (step > 0) & (step[np.minimum(place + step, n)] == step)
    proposed = np.cumsum(third)[last] - np.cumsum(third)[first] + third[first] > 0
    first, last = first[proposed], last[proposed]
    period = step[first]
    return first, last - first + period + length, period, again


def find(words: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period.

    ``words`` are numbers that differ between texts, ``doc`` the ascending number of the text.
    """
    if exponent < 4:
        raise ValueError("progressions of three need runs of four periods or more")
    n = len(words)
    size = np.bincount(doc)[doc] if n else doc
    at, names, length = np.arange(n), words, 1
    found = [(np.zeros(0, np.int64),) * 3]
    name = np.full(n + 1, -1, np.int64)
    while len(at):
        *runs, again = progressions(at, names, length, n)
        found.append(tuple(runs))
        name[:] = -1
        name[at[again]] = names[again]
        at, length = at[again], 2 * length
        # the halves come again, the factor lies in its text, and the text has room for a longer period
        fits = (at + length <= n) & (size[at] * 2 > exponent * length)
        at = at[fits]
        at = at[(name[at + length // 2] >= 0) & (doc[at + length - 1] == doc[at])]
        pair = name[at] * (n + 1) + name[at + length // 2]
        names = np.unique(pair, return_inverse=True)[1]
    start, span, period = (np.concatenate(x) for x in zip(*found))
    long_enough = span >= np.maximum(shortest, exponent * period)
    start, span, period = start[long_enough], span[long_enough], period[long_enough]
    _, once = np.unique(start * (n + 1) + period, return_index=True)
    return start[once], span[once], period[once]


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words: equal ones have one within a text and different ones across texts."""
    out, base = [np.zeros(0, np.int64)], 0
    for words in texts:
        ids = dict(zip(dict.fromkeys(words), range(base, base + len(words))))
        out.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        base += len(ids)
    return np.concatenate(out)


def _runs(batch: pa.RecordBatch, shortest: int, exponent: int, edit: Edit | None) -> Iterator[pa.RecordBatch]:
    ids = batch["doc_id"].to_pylist()
    for i, j, raw, bounds in W.blocks(batch["text"]):
        data = raw.tobytes()
        texts = [data[bounds[k]:bounds[k + 1]].split() for k in range(j - i)]
        if edit is not None:
            texts = [edit(ids[i + k], words) for k, words in enumerate(texts)]
        counts = np.array([len(words) for words in texts])
        first = np.append(0, np.cumsum(counts))
        doc = np.repeat(np.arange(j - i), counts)
        start, length, period = find(_numbers(texts), doc, shortest, exponent)
        edge = np.zeros(first[-1] + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        stays = np.cumsum(edge[:-1]) == 0
        cut = np.searchsorted(start, first)
        kept = [b" ".join(words if cut[k] == cut[k + 1] else compress(words, stays[first[k]:first[k + 1]].tolist()))
                for k, words in enumerate(texts)]
        entries = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - first[doc[start]], length, period)],
                                             names=["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].slice(i, j - i), pa.array(counts, pa.int64()),
             pa.ListArray.from_arrays(pa.array(cut, pa.int32()), entries), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT, edit: Edit | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed``.

    A run is a stretch of ``shortest`` words and ``exponent`` periods or more that cannot be extended;
    ``runs`` holds the start (from 0), length and least period of each, by start and period, and
    ``collapsed`` the words that no run contains after its first period, joined by single spaces.
    ``edit`` may change the words of a text first.
    """
    return by_batch(keyed(docs).drop("rk"), partial(_runs, shortest=shortest, exponent=exponent, edit=edit),
                    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the contract of the query makes periodic in one of ten documents; none for a null id."""
    h, n = 0 if doc_id is None else crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its runs, the longest of them, and a digest of what is left when they are collapsed."""
    found = runs(documents(spark, sf_dir), edit=planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("slow"))))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.slow")).alias("period"),
        F.expr("1000 * best.length div -best.slow").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The checksum goes by half bytes, low half first, through a table of 16 made by its rule.
OP12_SQL = """
WITH t AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS half),
o AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
             CAST(doc_id AS VARCHAR) AS id FROM documents),
h AS (SELECT k, doc_id, ws, xor(list_reduce(list_prepend(4294967295, list_transform(range(2 * length(id)), lambda i:
        CAST(instr('123456789ABCDEF', substr(hex(encode(id)), 1 + i + 1 - 2 * (i % 2), 1)) AS BIGINT))), lambda c, x:
        xor(half[CAST(xor(c, x) & 15 AS BIGINT) + 1], c >> 4)), 4294967295) AS h FROM o, t),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
e AS (SELECT k, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(len(ws)), lambda i:
        ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(ws) - a) // (3 + g % 8)) END]) END AS ws FROM a),
u AS (SELECT k, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM e),
q AS (SELECT x.k, x.i, y.i - x.i AS period FROM u x JOIN u y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
l AS (SELECT k, period, i, i - row_number() OVER (PARTITION BY k, period ORDER BY i) AS island FROM q),
s AS (SELECT k, period, min(i) AS start, count(*) + period AS length FROM l GROUP BY k, period, island
      HAVING count(*) + period >= greatest(6, 4 * period)),
r AS (SELECT s.* FROM s ANTI JOIN s AS z ON s.k = z.k AND z.period < s.period AND z.start <= s.start
      AND z.start + z.length >= s.start + s.length),
d AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN d USING (k, i) GROUP BY k),
b AS (SELECT k, count(*) AS n_runs, first(r ORDER BY length DESC, start, period) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN b USING (k) LEFT JOIN c USING (k)
"""
