"""Typed spans of a text and the digest columns that the scan queries return."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.tables import by_batch, hex256

#: A kind and the code points from start to end (exclusive).
Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the place of the kind in the list, joined by commas."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def span_columns(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]],
                 base: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """``doc_id``, a count per base kind, ``base_sha256`` and ``spans`` for each document.

    ``find`` gives the base spans and those that the method adds.  Null texts count as empty.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, shas, spans = {k: [] for k in base}, [], []
        for text in batch["text"]:
            found, more = find(text.as_py() or "")
            for k in base:
                counts[k].append(sum(s[0] == k for s in found))
            shas.append(hex256(joined(found, kinds).encode()))
            spans.append(joined([*found, *more], kinds))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(shas, pa.string()),
             pa.array(spans, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in base)}, base_sha256 string, spans string"
    return by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), work, schema)
