"""Benchmark decontamination: a broadcast hash set of test n-grams against all document windows.

Words are runs of letters and digits of ASCII and of anything beyond ASCII, A-Z lower-cased.  A window
is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window.  The hashes of all windows are broadcast in blocks of a bounded number of windows
(``BLOCK_WINDOWS``) and of bytes, words and item ids together (``BLOCK_BYTES``): a window that very many items
share is spread over blocks with its items.  A document window whose hash is in the set is verified word for word.  With one
block a document is finished where it is scanned, without any shuffle; with more blocks, every
document is scanned against one block after the other, whose hits are written before the next is read,
and the written hits are merged per document.

A null or empty text has no words and no hits; a very long one is scanned as a whole, at about 60 bytes of memory per
byte.  An item whose windows several items share counts for
each of them; a repeated item id counts once, and a null item id or text is ignored.  Repeated
documents get a row each, but are merged as one.  Extra columns are ignored; an empty benchmark hits nothing, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.tables import by_batch, documents, hex256, keyed, row_key, table
from tidemark.session import stored

WINDOW = 13
#: Windows of one broadcast set: about 100 MB with their words.
BLOCK_WINDOWS = 500_000
#: Bytes of the words and item ids of one set, and what an entry takes besides.
BLOCK_BYTES, ENTRY_BYTES = 100 << 20, 64
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
_TABLE = W.byte_map(W.NOT_ALNUM, lower=True)
#: Slots of the small filter that is asked before the hash set.
_FILTER = 1 << 20
_HITS = "doc_id long, rk long, n_words long, start array<int>, length array<int>, items array<string>"


@dataclass
class NgramSet:
    """Windows of some benchmark items: by length the sorted hashes, and the words and items of each."""

    hashes: dict[int, np.ndarray]
    filters: dict[int, np.ndarray]
    windows: dict[int, dict[bytes, tuple[str, ...]]]

    @classmethod
    def of(cls, windows: list[tuple[int, int, bytes, list[str]]]) -> NgramSet:
        """From rows of length, hash, words and items."""
        hashes, filters, texts = {}, {}, {}
        for n, h, words, items in windows:
            hashes.setdefault(n, []).append(h)
            texts.setdefault(n, {})[words] = tuple(items)
        for n, hs in hashes.items():
            hashes[n] = np.unique(np.array(hs, np.int64).view(np.uint64))
            filters[n] = np.zeros(_FILTER, bool)
            filters[n][(hashes[n] & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        return cls(hashes, filters, texts)


def _item_windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = []
    for i, j, words in W.word_blocks(batch["text"], _TABLE):
        h = words.hashes()
        for d in range(j - i):
            a, b = int(words.first[d]), int(words.first[d + 1])
            n = min(WINDOW, b - a)
            if n:
                item = batch["item_id"][i + d].as_py()
                rows += [(n, int(x), words.word_bytes(p, p + n), item) for p, x in
                         zip(range(a, b - n + 1), W.sequence_hashes(h[a:b], n).view(np.int64))]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.string()))],
        names=["n", "h", "words", "item"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows and items of a benchmark: length ``n``, hash ``h``, ``words`` and the ``item``."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text"))
    return by_batch(items.filter("item_id IS NOT NULL AND text IS NOT NULL"), _item_windows,
                    "n int, h long, words binary, item string").distinct()


def scan(texts: pa.Array, ngrams: NgramSet) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, tuple[str, ...]]]]]:
    """For each text: its place, its number of words, which words are hit, and the verified windows."""
    for i, j, words in W.word_blocks(texts, _TABLE):
        h = words.hashes()
        found: list[list[tuple[int, int, tuple[str, ...]]]] = [[] for _ in range(j - i)]
        for n, known in ngrams.hashes.items():
            seq = W.sequence_hashes(h, n)
            maybe = np.flatnonzero(ngrams.filters[n][(seq & np.uint64(_FILTER - 1)).astype(np.int64)])
            maybe = maybe[words.doc[maybe] == words.doc[maybe + n - 1]]
            at = np.minimum(np.searchsorted(known, seq[maybe]), len(known) - 1)
            for p in maybe[known[at] == seq[maybe]]:
                items = ngrams.windows[n].get(words.word_bytes(p, p + n))
                if items is not None:
                    d = int(words.doc[p])
                    found[d].append((int(p - words.first[d]), n, items))
        for d, hits in enumerate(found):
            n_words = int(words.counts[d])
            yield i + d, n_words, covered(n_words, hits), hits


def covered(n_words: int, hits: list) -> np.ndarray | None:
    """Which words lie in a window; None if there is no window."""
    if not hits:
        return None
    edge = np.zeros(n_words + 1, np.int64)
    for start, n, *_ in hits:
        edge[start] += 1
        edge[start + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def n_blocks(windows: DataFrame) -> int:
    """How many blocks the windows are taken in, from their number and size alone."""
    each = windows.groupBy("n", "h", "words").agg(F.sum(F.length("words") + F.length("item") + ENTRY_BYTES).alias("bytes"))
    size = each.agg(F.count(F.lit(1)).alias("windows"), F.sum("bytes").alias("bytes")).first()
    return max(1, -(-size.windows // BLOCK_WINDOWS), -(-(size.bytes or 0) // BLOCK_BYTES))


def blocks(windows: DataFrame) -> Iterator[list[tuple]]:
    """Benchmark windows with their items in blocks of about equal size; each block alone reaches the driver."""
    n = n_blocks(windows)
    for k in range(n):
        mine = windows if n == 1 else windows.filter(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == k)
        sets = mine.groupBy("n", "h", "words").agg(F.sort_array(F.collect_list("item")).alias("items"))
        yield [(r.n, r.h, bytes(r.words), list(r["items"])) for r in sets.collect()]


def verdict(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def _columns(batch: pa.RecordBatch, rows: list[tuple[int, int, set[str]]]) -> pa.RecordBatch:
    columns = {"n_words": pa.array([n for n, _, _ in rows], pa.int64()),
               "n_hit": pa.array([hit for _, hit, _ in rows], pa.int64()),
               "n_items": pa.array([len(items) for *_, items in rows], pa.int64()),
               "items_sha256": pa.array([hex256(",".join(sorted(items)).encode()) for *_, items in rows], pa.string()),
               "contaminated": pa.array([verdict(n, hit) for n, hit, _ in rows], pa.bool_())}
    return pa.RecordBatch.from_arrays([batch["doc_id"], batch["rk"], *columns.values()],
                                      names=["doc_id", "rk", *columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``rk``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` per document."""
    schema = "doc_id long, rk long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    docs, spark = keyed(docs), docs.sparkSession
    windows = stored(benchmark_windows(benchmark), "benchmark_windows")
    if n_blocks(windows) == 1:
        shared = spark.sparkContext.broadcast(NgramSet.of(next(blocks(windows))))

        def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [(n, 0 if hit is None else int(hit.sum()), {x for *_, items in hits for x in items})
                    for _, n, hit, hits in scan(batch["text"], shared.value)]
            yield _columns(batch, rows)
        return by_batch(docs, finish, schema)
    found = None
    for part in blocks(windows):
        shared = spark.sparkContext.broadcast(NgramSet.of(part))
        del part  # not held while the next one is read
        hits = stored(by_batch(docs, _hits_of(shared), _HITS).dropDuplicates(["rk"]), "benchmark_hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("rk", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("start")).alias("start"), F.flatten(F.collect_list("length")).alias("length"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def close(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for r in batch.to_pylist():
            hit = covered(r["n_words"], list(zip(r["start"], r["length"])))
            rows.append((r["n_words"], 0 if hit is None else int(hit.sum()), set(r["items"])))
        yield _columns(batch, rows)
    copies = docs.groupBy("rk").count()
    one = merged.join(copies, "rk").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    return by_batch(one.drop("again", "count"), close, schema)


def _hits_of(shared):
    def hits(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(n, [p for p, _, _ in hs], [k for _, k, _ in hs], sorted({x for *_, items in hs for x in items}))
                for _, n, _, hs in scan(batch["text"], shared.value)]
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["rk"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
            names=["doc_id", "rk", "n_words", "start", "length", "items"])
    return hits


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    windows = stored(benchmark_windows(benchmark), "benchmark_windows")
    if n_blocks(windows) > 1:
        bad = decontaminate(docs, benchmark).filter("contaminated").select("rk").distinct()
        return docs.join(bad, row_key(docs) == bad["rk"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(NgramSet.of(next(blocks(windows))))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([not verdict(n, 0 if hit is None else int(hit.sum()))
                                     for _, n, hit, _ in scan(batch["text"], shared.value)], pa.bool_()))
    return by_batch(docs, work, docs.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("rk")


OP5_SQL = """
WITH t AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, text FROM documents
           UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM t),
i AS (SELECT id AS item, least(13, CAST(len(ws) AS BIGINT)) AS n, ws FROM w WHERE side = 'b' AND len(ws) > 0),
b AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS win
      FROM i, LATERAL (SELECT unnest(generate_series(1, CAST(len(ws) AS BIGINT) - n + 1)) AS p)),
k AS (SELECT DISTINCT n FROM b),
s AS (SELECT id, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS win
      FROM w, k, LATERAL (SELECT unnest(generate_series(1, CAST(len(ws) AS BIGINT) - n + 1)) AS p)
      WHERE side = 'd' AND len(ws) >= n),
h AS (SELECT s.id, s.p, s.n, b.item FROM s JOIN b ON s.n = b.n AND s.win = b.win),
c AS (SELECT id, count(DISTINCT q) AS n_hit
      FROM (SELECT id, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY id),
m AS (SELECT id, count(DISTINCT item) AS n_items,
             sha256(string_agg(item, ',' ORDER BY item)) AS sha
      FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c ON c.id = w.id LEFT JOIN m ON m.id = w.id WHERE side = 'd'
"""
