"""Byte-level BPE: encoding with a priority queue over a linked list of symbols, and decoding.

A text is cut at special tokens, then into pieces by the pattern of the vocabulary.  Each piece starts
as a doubly linked list of byte symbols.  All neighbouring pairs that can merge wait in a queue by the
rank of their merge and their place; an entry whose symbols have changed meanwhile is stale and
skipped.  A piece of n bytes takes O(n log n) steps.  Ids are decoded by concatenating the byte
strings of the vocabulary.

Pieces repeat, so results are kept per worker in a cache of bounded size; it changes no result.
A null or empty text has no ids.  Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.tables import by_batch, documents, hex256

#: Entries of one generation of the cache; a worker holds at most two generations.
CACHE = 250_000
#: Documents whose ids are held at once.
BATCH = 256
#: White space as Unicode defines it (a fixed value).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies; the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in printable:
        out[b] = chr(b)
    rest = [b for b in range(256) if not out[b]]
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


class Codec:
    """Encoder and decoder of one vocabulary file with its special tokens and split pattern."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, symbols = data["model"]["vocab"], byte_symbols()
        back = {c: bytes([b]) for b, c in enumerate(symbols)}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings: dict[int, bytes] = {
            i: b"".join(back[c] for c in token) for token, i in vocab.items() if token not in special}
        self.strings.update((i, token.encode()) for token, i in special.items())
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")"
                                 ) if special else None
        self.first = [vocab[c] for c in symbols]
        self.rules: list[tuple[int, int, int]] = []
        for merge in data["model"]["merges"]:
            x, y = merge if isinstance(merge, list) else merge.split(" ")
            self.rules.append((vocab[x], vocab[y], vocab[x + y]))
        self.rank = {(x, y): rank for rank, (x, y, _) in enumerate(self.rules)}
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        #: Runs that end where pieces end: a space and what is not space, or white space alone.
        self.runs = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.decimal = {i: str(i) for i in self.strings}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece.

        An entry of the queue is the rank of a merge above the place of its left symbol, so the least
        entry is the next merge, the leftmost one on a tie.
        """
        ids = [self.first[b] for b in piece]
        n, rank, rules = len(ids), self.rank.get, self.rules
        queue = [r << 32 | i for i, r in enumerate(map(rank, zip(ids, ids[1:]))) if r is not None]
        if not queue:
            return ids
        heapify(queue)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            x, y, both = rules[entry >> 32]
            j = right[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = both, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = rank((both, ids[k]))
                if r is not None:
                    heappush(queue, r << 32 | i)
            h = left[i]
            if h >= 0:
                r = rank((ids[h], both))
                if r is not None:
                    heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def run(self, text: str) -> tuple[int, ...]:
        """Ids of a run of pieces that the young generation of the cache does not hold."""
        ids = self.old.get(text)
        if ids is None:
            pieces = self.pieces.findall(text)
            if len(pieces) == 1:
                ids = tuple(self.merge(text.encode()))
            else:  # each piece is a run of its own
                ids = tuple(chain.from_iterable([self.young.get(p) or self.run(p) for p in pieces]))
            if len(text) > 64:
                return ids  # long runs hardly repeat
        if len(self.young) >= CACHE:
            self.young, self.old = {}, self.young
        self.young[text] = ids
        return ids

    def plain(self, text: str) -> list[tuple[int, ...]]:
        known, run = self.young, self.run
        out = []
        for r in self.runs.findall(text):
            ids = known.get(r)
            if ids is None:
                ids = run(r)
                known = self.young  # a new generation may have begun
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(token in text for token in self.special):
            return list(chain.from_iterable(self.plain(text)))
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += chain.from_iterable(self.plain(part))
        return out

    def decode(self, ids: list[int]) -> str:
        """Unknown ids give nothing; bytes that are no UTF-8 become replacement characters."""
        return b"".join([self.strings.get(i, b"") for i in ids]).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """The codec of a worker, read once."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (if asked for), and digests of the ids and of what they decode to.

    ``path`` is the vocabulary file on every worker; by default the installed one.
    """
    names = ["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(path or vocabulary_path())
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            ids, shas, back = [], [], []
            for text in part["text"]:
                ids.append(own.encode(text.as_py() or ""))
                shas.append(hex256(",".join([own.decimal[i] for i in ids[-1]]).encode()))
                back.append(hex256(own.decode(ids[-1]).encode()))
            columns = {"doc_id": part["doc_id"], "n_tokens": pa.array(map(len, ids), pa.int64()),
                       "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), work,
                    ", ".join(f"{n} {kinds[n]}" for n in names))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode(documents(spark, sf_dir), with_ids=False)
