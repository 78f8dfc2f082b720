"""Importance resampling towards a target: hashed n-gram statistics of two corpora, a Gumbel draw.

A table of 256 bytes lower-cases A-Z and blanks every separator of the UTF-8 text, ``bytes.split``
yields the words, and the checksum of an n-gram is that of the one before, carried on over a space
and the next word: ``crc32(b" " + w, crc32(u)) == crc32(u + b" " + w)``.  Each task counts the buckets
of its batches in one Counter, Spark adds the counters up.  What reaches the driver is one number per
bucket and corpus, whatever the corpora hold.

The gain of a bucket is how much likelier the target makes it (smoothed by one, in thousandths of a
natural logarithm, rounded down), the weight of a document the sum of the gains of its features.  Adding
Gumbel noise, here a function of seed and id, and keeping the highest scores draws without replacement in
proportion to ``exp(weight / 1000)``.

Ranks are exact: rows are cut into written runs by range of score and id, and each run is moved up by the
rows before it; no task sorts them all.  A number tells equal rows apart, so that even many of them are cut.

A null or empty text has no features and weight 0.  A null id enters the noise as no digits and comes
before all others on ties; rows equal in every result are ranked one after the other.  A very
long text is worked through in pieces of a megabyte.  Empty tables count as corpora without features.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import by_batch, documents, keyed, table
from tidemark.llm.words import NOT_ALNUM
from tidemark.operators.ranking import ordered_rank
from tidemark.session import stored

LONGEST, BUCKETS = 3, 10_000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
PIECE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in NOT_ALNUM else c for c in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, lower-cased."""
    data, at = text.translate(_LOWER), 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def checksums(text: bytes, longest: int = LONGEST, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of a text its number of words and the checksums of the n-grams that end in it."""
    before: list[bytes] = []
    for new in pieces(text, size):
        words = before + new
        spaced = [b" " + w for w in words]
        crcs, out = list(map(crc32, words)), []
        for n in range(longest):
            if n:
                crcs = list(map(crc32, spaced[n:], crcs))
            out += crcs[max(len(before) - n, 0):]
        yield len(new), np.array(out, np.uint32)
        before = words[len(words) - longest + 1:] if len(words) >= longest else words
        before = before if longest > 1 else []


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch["text"].cast(pa.large_string()).cast(pa.large_binary()):
        yield text.as_py() or b""


def _counts(batch: pa.RecordBatch, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total: Counter[int] = Counter()
    for text in _texts(batch):
        for _, crcs in checksums(text, longest):
            total.update((crcs % buckets).tolist())
    yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())],
                                     names=["bucket", "n"])


def feature_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, the features of all texts in it; empty buckets have no row."""
    return by_batch(texts.select("text"), partial(_counts, longest=longest, buckets=buckets), "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket the gain; two numbers per bucket come to the driver."""
    s, t = ([0] * buckets for _ in range(2))
    for have, df in ((s, counts), (t, target)):
        for r in df.collect():
            have[r.bucket] = r.n
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(float(t[b] + 1) * all_s / (float(s[b] + 1) * all_t)))
                     for b in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel draw in thousandths, fixed by seed and id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(batch: pa.RecordBatch, gain: np.ndarray, longest: int, seed: int) -> Iterator[pa.RecordBatch]:
    n_words, n_features, weights = [], [], []
    for text in _texts(batch):
        words = features = weight = 0
        for n, crcs in checksums(text, longest):
            words, features = words + n, features + len(crcs)
            weight += int(gain[crcs % len(gain)].sum())
        n_words.append(words), n_features.append(features), weights.append(weight)
    scores = [w + noise(i, seed) for w, i in zip(weights, batch["doc_id"].to_pylist())]
    yield pa.RecordBatch.from_arrays(
        [batch["doc_id"], *[pa.array(x, pa.int64()) for x in (n_words, n_features, weights, scores)]],
        names=["doc_id", "n_words", "n_features", "weight", "score"])


def score(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
          seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row of ``docs``."""
    gain = gains(feature_counts(docs, longest, buckets), feature_counts(target, longest, buckets), buckets)
    return by_batch(keyed(docs).drop("rk"), partial(_scores, gain=gain, longest=longest, seed=seed),
                    "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             **parameters) -> DataFrame:
    """The rows of ``score`` with ``rank``: 1, 2, 3... of the drawn ones, null of all others.

    Drawn are the ``percent`` of the texts with ``least_words`` or more, rounded down, that score highest.
    """
    rows = stored(score(docs, target, **parameters), "scores")
    able = rows.filter(F.col("n_words") >= least_words) \
        .withColumns({"down": -F.col("score"), "row": F.monotonically_increasing_id()})
    quota = able.count() * percent // 100
    others = [F.col("doc_id").asc_nulls_first(), *(c for c in rows.columns if c not in ("doc_id", "score"))]
    ranked = ordered_rank(able, [], "down", others).drop("down", "row") \
        .withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")).cast("long"))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark and its rank in the draw."""
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum goes by half bytes, low half first, through a table of 16 made by its rule.
OP11_SQL = """
WITH t AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS half),
w AS (
  SELECT doc_id, 0 AS side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT item_id, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
d AS (SELECT *, row_number() OVER () AS k FROM w),
g AS (SELECT k, side, unnest(list_concat(
        ws,
        list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
        list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS feature
      FROM d),
c AS (SELECT k, side, feature, count(*) AS n FROM g GROUP BY ALL),
x AS (SELECT feature, list_transform(range(2 * strlen(feature)), lambda i:
        CAST(instr('123456789ABCDEF', substr(hex(encode(feature)), 1 + i + 1 - 2 * (i % 2), 1)) AS BIGINT)) AS halves
      FROM (SELECT DISTINCT feature FROM c)),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, halves), lambda c, h:
        xor(half[CAST(xor(c, h) & 15 AS BIGINT) + 1], c >> 4)), 4294967295) % 10000 AS bucket FROM x, t),
f AS (SELECT k, side, bucket, n FROM c JOIN b USING (feature)),
tot AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s_all, coalesce(sum(n) FILTER (side = 1), 0) AS t_all FROM f),
gain AS (SELECT bucket, CAST(floor(1000 * ln(
           CAST(coalesce(sum(n) FILTER (side = 1), 0) + 1 AS DOUBLE) * CAST(any_value(s_all) + 10000 AS DOUBLE)
           / (CAST(coalesce(sum(n) FILTER (side = 0), 0) + 1 AS DOUBLE) * CAST(any_value(t_all) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
         FROM f, tot GROUP BY bucket),
v AS (SELECT k, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY k),
s AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
             CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN v USING (k) WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
             count(*) FILTER (n_words >= 20) OVER () AS able FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM r
"""
