"""Quality rules: base counts, and tokeniser fertility in bands per script.

Every word is encoded by itself with two public vocabularies: pieces with byte fallback, and byte-level
BPE.  A document's fertility is its characters per token in each, the share of pieces that are fallback
bytes, and the entropy of its pieces as a share of the most that so many pieces can have.  Each script
has a band for each measure (``BANDS``); a document outside any of them is rejected, and so is one
that fails the base rule: fewer than ``LEAST_WORDS`` words, or more than half of them in repeated
three-word windows.  The floors of Latin and Cyrillic lie between generated junk and public text (the
message catalogues of programs, in all languages there), so base64, hex and random letters of mixed case
or Cyrillic are rejected.  Random or shuffled lower-case Latin letters, and random letters of the other
scripts, have as many characters per token as prose of languages the vocabularies hardly know: no
floor tells them apart, and they pass.

Words repeat, so their pieces are kept per worker in a cache of bounded size.  Words are runs of
anything but space and the controls 9 to 13.  A null or empty text has no words and fails the base
rule.  Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import words as W
from tidemark.llm.bpe import vocabulary_path
from tidemark.llm.tables import by_batch, documents, keyed

LEAST_WORDS, MOST_REPEATED = 50, 50
#: By script: least and most characters per piece, least characters per byte-level token, most share of
#: fallback bytes, least share of the possible entropy.
BANDS: dict[str, tuple[float, float, float, float, float]] = {
    "latin": (1.35, 12.0, 1.1, 0.20, 0.35),
    "greek": (0.8, 12.0, 0.4, 0.30, 0.35),
    "cyrillic": (1.18, 12.0, 0.4, 0.30, 0.35),
    "arabic": (0.6, 12.0, 0.4, 0.50, 0.35),
    "han": (0.3, 6.0, 0.25, 0.80, 0.35),
    "other": (0.25, 16.0, 0.2, 0.95, 0.30),
}
#: For Latin texts with more letters of other scripts than ``PURE`` leaves, such as Vietnamese.
MIXED, PURE = (1.05, 12.0, 0.6, 0.20, 0.35), 0.95
#: First bytes of the letters of each script in UTF-8; ASCII letters are Latin.
_LEADS = {"latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF],
          "cyrillic": range(0xD0, 0xD4), "arabic": range(0xD8, 0xDC), "han": range(0xE3, 0xEA),
          "other": [0xCA, 0xCB, 0xCC, 0xCD, *range(0xD4, 0xD8), *range(0xDC, 0xE3), *range(0xEA, 0xF5)]}
SCRIPTS = list(_LEADS)
#: Words and pieces that a worker remembers.
CACHE_WORDS, CACHE_PIECES = 200_000, 2_000_000
_SYMBOLS = b"#*$%&|<>"
_TABLE = W.byte_map(W.SPACES, lower=False)
_LINES = W.byte_map(b"\n", lower=False)
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Fertility:
    """Pieces of words in the vocabularies."""

    def __init__(self, pieces: str, byte_level: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.byte_level = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int64)

    def places(self, words: W.Words) -> np.ndarray:
        """Where the pieces of each word of a block are kept."""
        if len(self.place) > CACHE_WORDS or len(self.ids) > CACHE_PIECES:
            self.clear()
        hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.array([self.place.get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, at_first = words.raw.tobytes(), first[new]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in
                     zip(words.start[at_first].tolist(), words.end[at_first].tolist())]
            ids = self.pieces.encode(texts, num_threads=1)
            n = len(self.tokens)
            at[new] = np.arange(n, n + len(new))
            self.place.update(zip(hashes[new].tolist(), at[new].tolist()))
            self.first = np.append(self.first, self.first[-1] + np.cumsum([len(x) for x in ids]))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(ids), np.int64))
            self.tokens = np.append(self.tokens, [len(self.byte_level.encode_ordinary(" " + t)) for t in texts])
        return at[back]

    def measure(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: pieces, byte-level tokens, share of fallback bytes, share of the possible entropy."""
        n_docs = len(words.bounds) - 1
        at = self.places(words) if len(words.doc) else np.zeros(0, np.int64)
        size = self.first[at + 1] - self.first[at]
        doc = np.repeat(words.doc, size)
        ids = self.ids[np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(len(doc))]
        n = np.bincount(doc, minlength=n_docs)
        fallback = np.bincount(doc, self.is_byte[ids], n_docs) / np.maximum(n, 1)
        key, count = np.unique(doc * self.pieces.vocab_size() + ids, return_counts=True)
        share = count / n[key // self.pieces.vocab_size()]
        entropy = np.bincount(key // self.pieces.vocab_size(), -share * np.log2(share), n_docs)
        most = np.log2(np.clip(n, 2, self.pieces.vocab_size()))
        return n, np.bincount(words.doc, self.tokens[at], n_docs), fallback, entropy / most


@cache
def fertility(pieces: str, byte_level: str) -> Fertility:
    """The vocabularies of a worker, read once."""
    return Fertility(pieces, byte_level)


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(marks))
    return total[bounds[1:]] - total[bounds[:-1]]


def _group_sizes(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by text and hash, where groups of equals begin, and their sizes."""
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    heads = np.flatnonzero(new)
    return order, heads, np.diff(np.append(heads, len(d)))


def base_counts(words: W.Words) -> dict[str, np.ndarray]:
    """The base columns of each text of a block."""
    n_docs = len(words.bounds) - 1
    chars = (words.data != 0) & ((words.raw & 0xC0) != 0x80)
    lines = W.split(words.raw, words.bounds, _LINES)
    full = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_doc = lines.doc[full]
    _, heads, _ = _group_sizes(line_doc, lines.hashes()[full])
    distinct = np.bincount(np.sort(line_doc)[heads], minlength=n_docs) if len(line_doc) else np.zeros(n_docs, np.int64)
    seq = W.sequence_hashes(words.hashes(), 3)
    at = np.flatnonzero(W.inside(words, 3))
    order, heads, sizes = _group_sizes(words.doc[at], seq[at])
    repeated = at[order[np.repeat(sizes > 1, sizes)]]
    hit = np.zeros(len(words.doc), bool)
    for k in range(3):
        hit[repeated + k] = True
    return {"n_words": words.counts, "word_chars": _per_text(chars, words.bounds),
            "n_symbols": _per_text(np.isin(words.raw, np.frombuffer(_SYMBOLS, np.uint8)), words.bounds),
            "n_dup_lines": np.bincount(line_doc, minlength=n_docs) - distinct,
            "n_repeat_words": np.bincount(words.doc[hit], minlength=n_docs)}


def scripts(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The place of each text's most frequent script in ``SCRIPTS``, "other" without letters, and its share of the letters."""
    counts = []
    for leads in _LEADS.values():
        is_one = np.zeros(256, np.int64)
        is_one[list(leads)] = 1
        counts.append(_per_text(is_one[words.raw], words.bounds))
    counts = np.stack(counts, 1)
    share = counts.max(1) / np.maximum(counts.sum(1), 1)
    return np.where(counts.any(1), counts.argmax(1), len(SCRIPTS) - 1), share


def measures(words: W.Words, own: Fertility) -> dict[str, np.ndarray]:
    """Base columns, measures and verdicts of each text of a block."""
    out = base_counts(words)
    n, tokens, fallback, entropy = own.measure(words)
    out["chars_per_piece"] = out["word_chars"] / np.maximum(n, 1)
    out["chars_per_token"] = out["word_chars"] / np.maximum(tokens, 1)
    out["fallback"], out["entropy"] = fallback, entropy
    out["script"], share = scripts(words)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    least, most, least_token, most_bytes, least_entropy = np.array([*(BANDS[s] for s in SCRIPTS), MIXED])[
        np.where((out["script"] == SCRIPTS.index("latin")) & (share < PURE), len(SCRIPTS), out["script"])].T
    inside = ((out["chars_per_piece"] >= least) & (out["chars_per_piece"] <= most) & (out["chars_per_token"] >= least_token)
              & (fallback <= most_bytes) & (entropy >= least_entropy))
    out["kept"] = inside & ~out["base_failed"]
    return out


def judge(docs: DataFrame, pieces: str | None = None, byte_level: str | None = None) -> DataFrame:
    """Base columns, measures, ``base_failed`` and ``kept`` per document.

    ``pieces`` and ``byte_level`` are vocabulary files on every worker; by default the installed ones.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = fertility(pieces or vocabulary_path("piece_bpe_32k.model"),
                        byte_level or vocabulary_path("byte_bpe_50k.tiktoken"))
        for i, j, words in W.word_blocks(batch["text"], _TABLE):
            got = measures(words, own)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(i, j - i), *(pa.array(got[c].astype(np.int64)) for c in COLUMNS),
                 *(pa.array(got[c]) for c in ("chars_per_piece", "chars_per_token", "fallback", "entropy")),
                 pa.array([SCRIPTS[k] for k in got["script"]]), pa.array(got["base_failed"]), pa.array(got["kept"])],
                names=["doc_id", *COLUMNS, "chars_per_piece", "chars_per_token", "fallback", "entropy", "script",
                       "base_failed", "kept"])

    return by_batch(keyed(docs).select("doc_id", "text"), work,
                    f"doc_id long, {', '.join(c + ' long' for c in COLUMNS)}, chars_per_piece double, chars_per_token double, "
                    "fallback double, entropy double, script string, base_failed boolean, kept boolean")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    return judge(documents(spark, sf_dir)).select("doc_id", *COLUMNS, "base_failed", "kept")
