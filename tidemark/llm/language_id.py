"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word scores each language by the log of its relative frequency there.  An unseen word falls
back to its character n-grams of the longest order of which any is known, from ``ORDERS[0]`` down to
single letters, with a penalty per step.  A run of more than ``_LONGEST`` letters, as in scripts without
blanks, counts as that many words as it has pieces of nearly equal length, and every n-gram of the run
counts in one of them.  The sums over all words of a text are turned into
probabilities; the best language wins, the alphabetically first on a tie.

The model is learnt from the training folds: at most about ``ROWS`` documents of each language, chosen
by hash.  Words, and n-grams of all of them, are counted in Spark before anything is left out.  Of each
language the ``WORDS`` most frequent words and the ``WORDS`` most frequent n-grams of each order are kept
(by hash where counts are equal), with their counts in every language; so what is broadcast grows with
the number of languages, not with their documents, and a rare language loses nothing to a large one.
What a language was never seen with has the same frequency in all languages, however much was learnt
of each.

Letters are the characters of Unicode's categories L; the marks that follow them (vowel signs, accents) belong to the
word.  A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learnt.
Rows with a null language teach nothing.  Extra columns are ignored; repeated rows get equal results, and are all in the
sample or all out of it.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import by_batch, documents, held_out, keyed
from tidemark.session import stored

#: Documents of one language that are counted; words, and n-grams of each order, kept of one language.
ROWS, WORDS = 4_000, 100_000
ORDERS = (5, 4, 3, 2, 1)
#: Added to the counts of the language with the most, and the log penalty of each step down.
SMOOTH, STEP_DOWN = 0.5, 0.4
#: Unseen words whose scores a worker remembers.
CACHE = 400_000
#: Languages up to this number are broadcast to the rows; beyond, rows are shuffled.
BROADCAST_ROWS = 100_000
UNKNOWN = "und"


def _class(kinds: str) -> str:
    """The characters of some Unicode categories, as ranges of a pattern."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + "-" + re.escape(chr(c - 1)))
            start = None
    return "".join(out)


#: A letter and what follows of letters and marks; numbers that are no digits, such as fractions, are no letters.
_WORD, _ASCII_WORD = re.compile(f"[{_class('L')}][{_class('LM')}]*"), re.compile("[a-z]+")
#: Letters of a piece of a long run, and the mark of a piece where the run goes on.
_LONGEST, _JOIN = 40, "-"


def words_of(text: str) -> Counter[str]:
    """Runs of letters, longer ones in pieces; the same in learning and in look-up."""
    text = text.lower()
    runs = Counter((_ASCII_WORD if text.isascii() else _WORD).findall(text))
    for run in [r for r in runs if len(r) > _LONGEST]:
        n = runs.pop(run)
        for piece in pieces(run):
            runs[piece] += n
    return runs


def pieces(run: str) -> list[str]:
    """A long run of letters in parts of nearly equal length, with ``_JOIN`` where the run goes on.

    Each part but the last has the next few letters too, so that every n-gram of the run is in one part.
    """
    n = -(-len(run) // _LONGEST)
    cuts = [len(run) * i // n for i in range(n + 1)]
    return [_JOIN * (a > 0) + (run[a:b + ORDERS[0] - 1] + _JOIN if b < len(run) else run[a:b]) for a, b in zip(cuts, cuts[1:])]


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word between its edges, or those that begin in a piece of a long run."""
    more = word.endswith(_JOIN)
    padded = word.strip(_JOIN)
    if order > 1:
        padded = " " * (not word.startswith(_JOIN)) + padded + " " * (not more)
    n = len(padded) - (ORDERS[0] if more else order) + 1
    return [padded[i:i + order] for i in range(n)]


class Table:
    """Log frequencies of keys by language: a floor for each key, and what is above it where it was counted."""

    def __init__(self, n_languages: int, first: np.ndarray, lang: np.ndarray, above: np.ndarray, floor: np.ndarray) -> None:
        self.n_languages, self.first, self.lang, self.above, self.floor = n_languages, first, lang, above, floor

    def __getitem__(self, row: int) -> np.ndarray:
        return self.sums(np.array([row]), np.ones(1), np.zeros(1, np.int64), 1)[0]

    def sums(self, rows: np.ndarray, times: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
        """Sums of the given rows, so many times each, by group and language."""
        size = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(group, size) * self.n_languages + self.lang[at]
        out = np.bincount(cell, self.above[at] * np.repeat(times, size), n_groups * self.n_languages)
        return out.reshape(n_groups, -1) + np.bincount(group, self.floor[rows] * times, n_groups)[:, None]


class Model:
    """Log frequencies by language of known words and n-grams.

    Rows of unseen words are added to ``extra`` as they come, up to ``CACHE``, and then dropped again.
    """

    def __init__(self, counts: list[tuple[str, str, int]] | pa.Table, totals: dict[tuple[str, int], int] | None = None) -> None:
        """From rows of language, word and count, or from a table of the kept keys.

        ``totals`` are the counts of each language and kind of key before some were left out.
        """
        keys = counts if isinstance(counts, pa.Table) else pa.Table.from_batches([_keys(counts)]).group_by(
            ["lang", "kind", "key"]).aggregate([("n", "sum")]).rename_columns(["lang", "kind", "key", "n"])
        keys = keys.sort_by([("kind", "ascending"), ("key", "ascending"), ("lang", "ascending")]).combine_chunks()
        self.languages = sorted(keys["lang"].unique().to_pylist())
        lang = pc.index_in(keys["lang"], pa.array(self.languages, pa.string())).to_numpy().astype(np.int64)
        kind, n = keys["kind"].to_numpy(), keys["n"].to_numpy().astype(float)
        code = keys["key"].combine_chunks().dictionary_encode().indices.to_numpy() if len(n) else kind
        head = np.ones(len(n), bool)
        head[1:] = (kind[1:] != kind[:-1]) | (code[1:] != code[:-1])
        first = np.append(np.flatnonzero(head), len(n))
        names, kinds = keys["key"].take(pa.array(first[:-1])).to_pylist(), kind[first[:-1]]
        above, floor = np.zeros(len(n)), np.zeros(len(names))
        for k in (0, *ORDERS):
            mine = kind == k
            total = np.bincount(lang[mine], n[mine], len(self.languages))
            if totals:
                total = np.array([float(totals.get((x, k), 0)) for x in self.languages])
            least, total = SMOOTH / max(total.max(initial=0), 1), np.maximum(total, 1)
            above[mine] = np.log((n[mine] / total[lang[mine]] + least) / least)
            floor[kinds == k] = np.log(least / (1 + least * (kinds == k).sum()))
        self.known = int((kinds == 0).sum())
        self.words = {w: i for i, w in enumerate(names[:self.known])}
        self.grams = {g: i for i, g in enumerate(names[self.known:])}
        cut = first[self.known]
        self.table = Table(len(self.languages), first[:self.known + 1], lang[:cut], above[:cut], floor[:self.known])
        self.gram_table = Table(len(self.languages), first[self.known:] - cut, lang[cut:], above[cut:], floor[self.known:])
        self.seen: dict[str, int] = {}
        self.extra = np.zeros((0, len(self.languages)))

    def backoff(self, words: list[str]) -> np.ndarray:
        """Log frequencies of unseen words in each language, by the longest known n-grams of each."""
        rows, flat, size, steps = self.grams, [], [], []
        for word in words:
            found: list[int] = []
            for step, order in enumerate(ORDERS, 1):
                found = [rows[g] for g in grams(word, order) if g in rows]
                if found:
                    break
            flat += found
            size.append(len(found))
            steps.append(step)
        out = np.zeros((len(words), len(self.languages)))
        n = np.array(size)
        full = np.flatnonzero(n)
        if len(full):
            total = self.gram_table.sums(np.array(flat), np.ones(len(flat)), np.repeat(np.arange(len(n)), n), len(n))[full]
            out[full] = total / n[full, None] - STEP_DOWN * np.array(steps)[full, None]
        return out

    def remember(self, words: list[str]) -> None:
        """Add rows of words that have none yet."""
        first = len(self.seen)
        self.seen.update(zip(words, range(first, first + len(words))))
        if first + len(words) > len(self.extra):
            more = max(len(words), len(self.extra) // 2, 1024)
            self.extra = np.concatenate([self.extra, np.zeros((more, len(self.languages)))])
        self.extra[first:first + len(words)] = self.backoff(words)

    def word(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language."""
        return self.table[self.words[word]] if word in self.words else self.backoff([word])[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self.seen) > CACHE:
            self.seen = {}
        known, seen = self.words, self.seen
        old = [w for w in words if w in known]
        unseen = [w for w in words if w not in known]
        if new := [w for w in unseen if w not in seen]:
            self.remember(new)
        total = np.zeros(len(self.languages))
        if old:
            times = np.array([words[w] for w in old], float)
            total += self.table.sums(np.array([known[w] for w in old]), times, np.zeros(len(old), np.int64), 1)[0]
        if unseen:
            total += np.array([words[w] for w in unseen], float) @ self.extra[[seen[w] for w in unseen]]
        best = int(total.argmax())
        return self.languages[best], round(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()), 9)


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    total: dict[str, Counter[str]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
        total.setdefault(lang, Counter()).update(words_of(text.as_py()))
    rows = [(lang, w, n) for lang, words in total.items() for w, n in words.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))],
        names=["lang", "word", "n"])


def _keys(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    """Counts of words (kind 0) and of their n-grams (kind: the order)."""
    total: dict[str, list[Counter[str]]] = {}
    for lang, word, n in rows:
        kinds = total.setdefault(lang, [Counter() for _ in range(max(ORDERS) + 1)])
        kinds[0][word] += n
        for order in ORDERS:
            count = kinds[order]
            for gram in grams(word, order):
                count[gram] += n
    out = [(lang, k, key, n) for lang, kinds in total.items() for k, count in enumerate(kinds) for key, n in count.items()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))],
        names=["lang", "kind", "key", "n"])


def _expanded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = list(zip(*(batch[c].to_pylist() for c in ("lang", "word", "n"))))
    for i in range(0, len(rows), 10_000):
        yield _keys(rows[i:i + 10_000])


def _least(steps: list[tuple[int, int]]) -> tuple[int, float]:
    """The count above which all keys are kept, and the share of those kept that have it, from counts and numbers of keys."""
    left = WORDS
    for n, keys in sorted(steps, reverse=True):
        if keys > left:
            return n, left / keys
        left -= keys
    return 0, 0.0


def kept(keys: DataFrame) -> tuple[DataFrame, dict[tuple[str, int], int]]:
    """The rows of the keys that are kept in some language, and the sum of all counts by language and kind."""
    sizes = keys.groupBy("lang", "kind").agg(F.count("*").alias("keys"), F.sum("n").alias("total")).collect()
    totals = {(r.lang, r.kind): r.total for r in sizes}
    over = [(r.lang, r.kind) for r in sizes if r["keys"] > WORDS]
    if not over:
        return keys, totals
    spark = keys.sparkSession
    steps: dict[tuple[str, int], list[tuple[int, int]]] = {}
    large = F.broadcast(spark.createDataFrame(over, "lang string, kind int"))
    for r in keys.join(large, ["lang", "kind"]).groupBy("lang", "kind", "n").agg(F.count("*").alias("keys")).toLocalIterator():
        steps.setdefault((r.lang, r.kind), []).append((r.n, r["keys"]))
    least = spark.createDataFrame([(*k, *_least(v)) for k, v in steps.items()], "lang string, kind int, least long, share double")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    stay = (keys.join(F.broadcast(least), ["lang", "kind"], "left")
            .filter(F.col("least").isNull() | (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (place < F.col("share")))))
    return keys.join(stay.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("lang", "kind", "key", "n"), totals


def learn(docs: DataFrame) -> Model:
    """The model of the training folds."""
    rows = docs.select(docs["lang"].alias("lang"), docs["text"].alias("text"), docs["doc_id"].cast("long").alias("doc_id"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows.groupBy("lang").agg((F.lit(ROWS) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    if share.count() <= BROADCAST_ROWS:
        share = F.broadcast(share)
    sample = rows.join(share, "lang").filter(place < F.col("share")).select("lang", "text")
    words = (by_batch(sample, _counted, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    keys = stored(by_batch(words, _expanded, "lang string, kind int, key string, n long")
                  .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "language_keys")
    top, totals = kept(keys)
    return Model(top.toArrow(), totals)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` per document."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [model.value.predict(text.as_py()) for text in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array([g[0] for g in got], pa.string()),
             pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = keyed(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return by_batch(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(documents(spark, sf_dir))
