"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct shingles of ``SHINGLE`` words; two documents link when
``100 * |intersection| >= PERCENT * |union|``.  The result is the component of every document.

1. Equal sets become one member.
2. *Groups of similar documents.*  A linked pair of sizes a and b differs in at most
   ``(a + b) * (100 - PERCENT) / (100 + PERCENT)`` shingles.  Shingles are dealt by hash into more
   parts than that, so a linked pair has a part with the same shingles on both sides.  The hashes of
   the parts are the signatures.  All members with a signature join the group of the least of them, so
   a group holds members that share a part with its first, and a linked pair meets in some group.  A
   member that, by empty parts, cannot be sure of a shared one deals again with another hash until it
   can; the pair then shares a part of the deal at which the first of the two is sure.
   No link is lost and no shingle is ever joined with a frequent one.
3. *Matrix.*  A group is cut into blocks and these into tiles of a few members.  The matrix holds,
   by shingle and tile, whether any member of the tile has the shingle: the tile's union.
4. *Bound and open.*  ``|q and union|`` bounds the overlap of q with each member of the tile.  Only
   tiles with ``100 * bound >= PERCENT * |q|`` are opened, and overlaps with their members counted
   exactly.  A block of work sends out a spanning forest of its links, never the pairs.
5. Links of all blocks are merged by :func:`tidemark.llm.components.components`.

Hot groups: a signature sends one row per Arrow batch to the shuffle, with its members there; a group
over the size of a block is split into blocks, and blocks meet in pairs, each a task of bounded size.
Sets of equal 64-bit hash are taken as equal.

Words are runs of anything but space and the controls 9 to 13, with A-Z lower-cased.  A text of fewer
than ``SHINGLE`` words has its whole sequence as the one shingle.  A null, empty or blank text has an
empty set, links with nothing and is its own component.  ``component_id`` is the least non-null id of
the component.  Rows that repeat an id or a text are documents of their own with equal sets.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.tables import by_batch, documents, keyed, row_key
from tidemark.session import stored

SHINGLE, PERCENT = 4, 85
#: A block of a group holds about so many members or shingles, a tile so many members.
BLOCK_MEMBERS, BLOCK_SHINGLES, TILE = 512, 1 << 20, 16
#: Values of a dense slice of the matrix (4 bytes each).
SLICE = 1 << 23
#: Candidates up to this number are broadcast to the texts (at ``ROW_BYTES`` each); beyond, texts are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of a broadcast row, and of each group that it lists.
ROW_BYTES, GROUP_BYTES = 60, 32
_TABLE = W.byte_map(W.SPACES, lower=True)
_ODD = np.uint64(0x9FB21C651E98DF25)


def _size_classes() -> np.ndarray:
    """First sizes of the size classes; each is 1.6 times the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return np.array(out, np.int64)


CLASSES = _size_classes()


def shingle_sets(words: W.Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block, sorted by text and hash: text of each, hash of each."""
    h = words.hashes()
    grams = W.sequence_hashes(h, shingle)
    whole = W.inside(words, shingle)
    doc, token = [words.doc[:len(grams)][whole]], [grams[whole]]
    for n in range(1, shingle):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            doc.append(short)
            token.append(W.mix(W.sequence_hashes(h, n)[words.first[short]] + np.uint64(n)))
    doc, token = np.concatenate(doc), np.concatenate(token)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def set_keys(doc: np.ndarray, token: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit key of each text's set."""
    size = np.bincount(doc, minlength=n_docs)
    total = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum(W.mix(token * _ODD), out=total[1:])
    edge = np.append(0, np.cumsum(size))
    return size, W.mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64) * _ODD)


def signatures(size: np.ndarray, token: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets laid end to end: the set of each and the signature of each."""
    first = np.cumsum(size) - size
    own = np.searchsorted(CLASSES, size, "right") - 1
    up = np.flatnonzero(100 * size >= percent * CLASSES[own + 1])
    member, level = np.append(np.arange(len(size)), up), np.append(own, own[up] + 1)
    member, level = member[size[member] > 0], level[size[member] > 0]
    out, deal = [], 0
    while len(member):
        most = CLASSES[level + 1] - 1
        parts = 2 * most * (100 - percent) // (100 + percent) + 1
        parts += parts // 32
        n = size[member]
        base = np.cumsum(parts) - parts
        entry = np.repeat(np.arange(len(member)), n)
        at = np.repeat(first[member], n) + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        h = W.mix(token[at] + np.uint64((deal + 1) * int(_ODD) % 2**64))
        slot = base[entry] + (((h >> np.uint64(32)) * parts[entry].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        value = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(value, slot, W.mix(h))
        full = np.zeros(len(value), bool)
        full[slot] = True
        owner = np.repeat(np.arange(len(member)), parts)
        place = np.arange(len(value)) - base[owner]
        tag = (place * 64 + level[owner]).astype(np.uint64) * np.uint64(64) + np.uint64(deal)
        out.append((member[owner[full]], W.mix(value[full] + W.mix(tag[full]))))
        differ = (n + np.minimum(most, 100 * n // percent)) * (100 - percent) // (100 + percent)
        again = np.bincount(owner[full], minlength=len(member)) <= differ
        member, level, deal = member[again], level[again], deal + 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()],
                                      names=list(columns))


def _profile(batch: pa.RecordBatch, shingle: int) -> Iterator[pa.RecordBatch]:
    for i, j, words in W.word_blocks(batch["text"], _TABLE):
        size, key = set_keys(*shingle_sets(words, shingle), j - i)
        yield _batch({"doc_id": batch["doc_id"].slice(i, j - i), "rk": batch["rk"].slice(i, j - i),
                      "n_shingles": size.astype(np.int64), "k": key.view(np.int64)})


def _signed(batch: pa.RecordBatch, shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each signature of the batch: its least member ``k`` and the others."""
    sig, key = [], []
    for i, j, words in W.word_blocks(batch["text"], _TABLE):
        doc, token = shingle_sets(words, shingle)
        size, k = set_keys(doc, token, j - i)
        _, one = np.unique(k, return_index=True)
        pick = np.zeros(j - i, bool)
        pick[one] = True
        pick &= size > 0
        member, s = signatures(size[pick], token[pick[doc]], percent)
        sig.append(s)
        key.append(k[pick][member])
    sig, key = np.concatenate(sig), np.concatenate(key).view(np.int64)
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    again = same.copy()
    again[1:] &= key[1:] == key[:-1]
    sig, key, same = sig[~again], key[~again], same[~again]
    heads = np.flatnonzero(~same)
    more = np.diff(np.append(heads, len(sig))) - 1
    others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(more)).astype(np.int32)),
                                      pa.array(key[same]), mask=pa.array(more == 0))
    yield pa.RecordBatch.from_arrays([pa.array(sig[heads].view(np.int64)), pa.array(key[heads]), others],
                                     names=["g", "k", "others"])


def _tokens(batch: pa.RecordBatch, shingle: int) -> Iterator[pa.RecordBatch]:
    for i, j, words in W.word_blocks(batch["text"], _TABLE):
        doc, token = shingle_sets(words, shingle)
        size, _ = set_keys(doc, token, j - i)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)),
                                         pa.array(token.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch["k"].slice(i, j - i), batch["homes"].slice(i, j - i), lists],
                                         names=["k", "homes", "tokens"])


def link_forest(sets: list[np.ndarray], percent: int = PERCENT, tile: int = TILE,
                halves: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets of hashes; with ``halves``, of those across them.

    The matrix of tile unions bounds each overlap first; only tiles that can hold a partner are opened.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((np.arange(n), size))
    doc = np.repeat(np.arange(n), size[order])
    token, col = np.unique(np.concatenate([sets[i] for i in order]) if n else np.zeros(0), return_inverse=True)
    shared = np.bincount(col, minlength=len(token)) > 1
    place = np.cumsum(shared) - 1
    doc, col = doc[shared[col]], place[col[shared[col]]]
    width, step = int(shared.sum()), max(1, SLICE // max(n, 1))
    by_col = np.argsort(col, kind="stable")
    doc, col = doc[by_col], col[by_col]
    heads = np.arange(0, n, tile)
    bound = np.zeros((n, len(heads)), np.float32)

    def slices() -> Iterator[np.ndarray]:
        for c in range(0, width, step):
            a, b = np.searchsorted(col, [c, c + step])
            part = np.zeros((n, min(step, width - c)), np.float32)
            part[doc[a:b], col[a:b] - c] = 1
            yield part

    for part in slices():
        bound += part @ np.maximum.reduceat(part, heads, axis=0).T
    size = size[order]
    least = np.minimum(size[:, None], size[None, :])
    possible = 100 * bound >= percent * size[:, None]
    open_tiles = np.flatnonzero(possible.any(0))
    overlap = np.zeros((n, n), np.float32)
    for part in slices():
        for t in open_tiles:
            q = np.flatnonzero(possible[:, t])
            rows = slice(heads[t], min(n, heads[t] + tile))
            overlap[q, rows] += part[q] @ part[rows].T
    linked = (100 + percent) * overlap.astype(np.int64) >= percent * (size[:, None] + size[None, :])
    linked &= (least > 0) & ~np.eye(n, dtype=bool)
    if halves is not None:
        side = np.asarray(halves)[order]
        linked &= side[:, None] != side[None, :]
    linked |= linked.T
    forest, seen = [], np.zeros(n, bool)
    for start in range(n):
        if seen[start]:
            continue
        seen[start], queue = True, [start]
        while queue:
            x = queue.pop()
            more = np.flatnonzero(linked[x] & ~seen)
            seen[more] = True
            forest += [(int(order[x]), int(order[y])) for y in more]
            queue += more.tolist()
    return forest


def _links(table: pa.Table, percent: int) -> pa.Table:
    """A forest of the links inside one block, or between two blocks, of a group."""
    keys, one = np.unique(table["k"].to_numpy(), return_index=True)
    lists = table["tokens"].combine_chunks().take(pa.array(one))
    edge, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    side = table["block"].to_numpy()[one]
    forest = link_forest([flat[edge[i]:edge[i + 1]] for i in range(len(keys))], percent,
                         halves=side if side.min() != side.max() else None)
    pairs = np.array(forest, np.int64).reshape(-1, 2)
    return pa.table({"a": keys[pairs[:, 0]], "b": keys[pairs[:, 1]]})


def small(homes: DataFrame) -> bool:
    """Whether rows with lists of groups are no larger than ``BROADCAST_ROWS`` rows with one group each."""
    size = homes.agg(F.sum(F.lit(ROW_BYTES) + GROUP_BYTES * (F.size("homes") - 1))).first()[0]
    return (size or 0) <= ROW_BYTES * BROADCAST_ROWS


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, row key ``rk``, ``n_shingles``, ``component_id`` and the row key of the one to keep, per document."""
    docs = keyed(docs)
    profile = stored(by_batch(docs, partial(_profile, shingle=shingle),
                              "doc_id long, rk long, n_shingles long, k long"), "profile")
    signed = by_batch(docs.select("text"), partial(_signed, shingle=shingle, percent=percent),
                      "g long, k long, others array<long>")
    grouped = (signed.withColumn("grp", F.min("k").over(Window.partitionBy("g")))
               .filter("k <> grp OR others IS NOT NULL")
               .select("grp", F.explode(F.concat(F.array("k"), F.coalesce("others", F.array().cast("array<long>")))).alias("k"))
               .distinct())
    grouped = stored(grouped, "groups")
    grouped = grouped.unionByName(grouped.select("grp", F.col("grp").alias("k"))).distinct()
    sets = profile.filter("n_shingles > 0").groupBy("k").agg(F.min("rk").alias("rk"), F.min("n_shingles").alias("n"))
    members = stored(grouped.join(sets, "k"), "members")
    sizes = members.groupBy("grp").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    homes = stored(members.join(sizes, "grp").groupBy("rk", "k").agg(F.collect_list(F.struct("grp", "blocks")).alias("homes")),
                   "homes")
    if small(homes):
        homes = F.broadcast(homes)
    tokens = by_batch(docs.select("rk", "text").join(homes, "rk").select("text", "k", "homes"),
                      partial(_tokens, shingle=shingle),
                      "k long, homes array<struct<grp: long, blocks: int>>, tokens array<long>")

    def forest(block: pa.Table) -> pa.Table:
        return _links(block, percent)

    met = (tokens.select("k", "tokens", F.explode("homes").alias("home")).select("k", "tokens", "home.grp", "home.blocks")
           .withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")))
    links = (met.select("grp", "x", "y", "block", "k", "tokens").groupBy("grp", "x", "y")
             .applyInArrow(forest, "a long, b long"))
    root = components(links).select(F.col("node").alias("k"), "root")
    placed = profile.join(root, "k", "left").withColumn("root", F.coalesce("root", "k"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk"))
    top = stored(placed.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"),
                                                                     first["rk"].alias("keeper")), "tops")
    # written, so that a component with very many documents is a skewed key that the join may split
    own = F.col("n_shingles") == 0
    return placed.join(top, "root", "left").select(
        "doc_id", "rk", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(own, F.col("rk")).otherwise(F.col("keeper")).alias("keeper"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one of least id, with all its columns.

    Documents without words all stay.  Of rows that repeat both id and text of the one that stays, the one whose
    columns come first as text is kept, however the rows are laid out.
    """
    found = stored(jaccard_components(docs, shingle, percent).select("rk", "keeper", "n_shingles"), "components")
    gone = found.filter("rk <> keeper").select("rk").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, row_key(docs) == gone["rk"], "left_anti")
    again = found.filter("rk = keeper AND n_shingles > 0").groupBy("rk").count().filter("count > 1").select("rk")
    if again.isEmpty():
        return left
    copies = left.join(again, row_key(left) == again["rk"], "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in copies.columns])
    one = copies.groupBy(row_key(copies).alias("_rk")).agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
    return left.join(again, row_key(left) == again["rk"], "left_anti").unionByName(one.select("_row.*"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 3), ' ') AS sh
      FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(1, CAST(len(ws) AS BIGINT) - 3))) AS p)
      WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON r.doc_id = e.a),
c AS (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
