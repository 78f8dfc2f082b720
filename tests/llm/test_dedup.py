"""Near duplicates, repeated passages, benchmark hits and licenses against SQL and brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import check
from tests.llm.helpers import frame, rows
from tidemark.llm import decontamination, license_scan, ngram_jaccard_join, substring_dedup
from tidemark.llm import words as W
from tidemark.llm.queries import ORACLE, QUERIES
from tidemark.llm.tables import keyed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLE))
def test_agrees_with_sql(spark, sf, con, name):
    got = check.compare(name, QUERIES[name](spark, sf), con, ORACLE[name])
    assert got.startswith("ok") and got != "ok 0", got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x00\x0bé日A.", max_size=30), max_size=8))
def test_words_of_a_batch(texts):
    for table, pattern in ((W.byte_map(W.SPACES, True), WORD), (W.byte_map(W.NOT_ALNUM, True), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        got = [[] for _ in texts]
        for i, _, words in W.word_blocks(pa.array(texts, pa.string()), table):
            for k in range(len(words.doc)):
                got[i + words.doc[k]].append(words.raw[words.start[k]:words.end[k]].tobytes().decode().lower())
            by_hash = {}
            for k, h in enumerate(words.hashes()):
                assert by_hash.setdefault(h, words.word_bytes(k, k + 1)) == words.word_bytes(k, k + 1)
            assert len(by_hash) == len({words.word_bytes(k, k + 1) for k in range(len(words.doc))})
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
        assert got == [pattern.findall(t) for t in low]


def passages(docs, window=20):
    """Words that stay, per row, by definition."""
    first = {}
    texts = [WORD.findall(t or "") for _, t in docs]
    for (i, _), ws in zip(docs, texts):
        for p in range(len(ws) - window + 1):
            key, at = tuple(ws[p:p + window]), (-2**63 if i is None else i, p)
            first[key] = min(first.get(key, at), at)
    out = []
    for (i, _), ws in zip(docs, texts):
        gone = {q for p in range(len(ws) - window + 1) if first[tuple(ws[p:p + window])] < (-2**63 if i is None else i, p)
                for q in range(p, p + window)}
        out.append((i, len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone)))
    return out


def made_texts(seed, n=120):
    """Texts made of shared passages, with copies, edits, repeats and ties."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["a", "b", "É"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 35, 60]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(shared) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        if words and rng.random() < 0.5:
            words[rng.randrange(len(words))] = "edit"
        texts.append((" " if rng.random() < 0.5 else "\n\t").join(words))
    return texts


def test_passages_equal_brute_force(spark):
    texts = made_texts(3)
    docs = list(enumerate(texts)) + [(7, texts[7]), (8, texts[9]), (None, texts[3]), (None, texts[4]), (500, None), (501, ""), (502, "x " * 30000)]
    random.Random(1).shuffle(docs)
    got = rows(substring_dedup.remove_repeats(frame(spark, docs).repartition(5)))
    want = sorted(passages(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == want
    assert sum(r[2] for r in want) > 1000
    assert substring_dedup.remove_repeats(frame(spark, docs).limit(0)).count() == 0


def shingle_set(text, n=4):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[p:p + n]) for p in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def classes(docs, percent=85):
    sets = [shingle_set(t) for _, t in docs]
    top = list(range(len(docs)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def near_copies(seed, n_bases=5, copies=40):
    rng = random.Random(seed)
    out = []
    for b in range(n_bases):
        base = [f"b{b}x{k}" for k in range(rng.choice([3, 8, 30, 90, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(words[:rng.choice([len(words), len(words), len(words) - 1])]))
    return out


@pytest.mark.parametrize("blocks", [(512, 16), (8, 3)])
def test_components_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_jaccard_join, "BLOCK_MEMBERS", blocks[0])
    monkeypatch.setattr(ngram_jaccard_join, "TILE", blocks[1])
    monkeypatch.setattr(ngram_jaccard_join, "BROADCAST_ROWS", 1_000_000 if blocks[0] > 8 else 0)
    texts = near_copies(5)
    docs = list(enumerate(texts)) + [(9, texts[9]), (900, None), (901, ""), (902, " \n"), (903, "One Two"), (904, "one two"), (None, texts[3]), (None, "solo text of no one")]
    random.Random(2).shuffle(docs)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join.jaccard_components(frame(spark, docs).repartition(6)).collect()]
    want = classes(docs)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({c for *_, c in want}) < len(docs) - 60
    kept = ngram_jaccard_join.keep_one(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    ids = [r["doc_id"] for r in rows(kept)]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, n, c in want if c is not None})
    assert ids.count(None) == 1


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert ngram_jaccard_join.jaccard_components(none).count() == 0 and ngram_jaccard_join.keep_one(none).count() == 0
    assert license_scan.scan(none).count() == 0 and license_scan.scan(frame(spark, [(1, "x")]), []).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400))
def test_linked_sets_share_a_signature(seed, n):
    """Whatever the sizes, sets at the threshold meet in at least one signature."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(1, 2**63, 2 * n + 2, dtype=np.uint64)
    a = pool[:n]
    for both in range(n, 0, -1):
        for b_size in {both, n, both + max(0, int((both * 185) / 85) - n - both)}:
            if b_size < both or 100 * both < 85 * (n + b_size - both) or 100 * (both - 1) >= 85 * (n + b_size - both + 1):
                continue
            b = np.concatenate([a[:both], pool[n:n + b_size - both]])
            member, s = ngram_jaccard_join.signatures(np.array([n, b_size]), np.concatenate([np.sort(a), np.sort(b)]), 85)
            assert set(s[member == 0].tolist()) & set(s[member == 1].tolist())


def hits(text, items):
    """Words, hit words and items by definition."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        ws = low(t)
        n = min(13, len(ws))
        for p in range(len(ws) - n + 1) if n else ():
            for q in range(len(words) - n + 1):
                if words[q:q + n] == ws[p:p + n]:
                    hit |= set(range(q, q + n))
                    found.add(item)
    return len(words), len(hit), len(found)


@pytest.mark.parametrize("block", [500_000, 3])
def test_benchmark_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    item = [f"q{k}" for k in range(20)]
    items = [(1, " ".join(item)), (2, "Short Item, é!"), (3, " ".join(item[5:])), (4, None), (5, "..."), (2, "Short Item, é!"), (None, "a b")]
    texts = ["x " * 30 + " ".join(item), " ".join(item[:13]), " ".join(item[:12]), "the short-ITEM É short item é", None, "", " ".join(item[5:19]) + " tail" * 400]
    docs = [*enumerate(texts), (0, texts[0]), (None, texts[1])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = rows(decontamination.decontaminate(frame(spark, docs), benchmark))
    known = [(i, t) for i, t in items if i is not None]
    want = sorted(((d, *hits(t, known)) for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got] == want
    clean = decontamination.keep_clean(frame(spark, docs), benchmark)
    assert clean.columns == frame(spark, docs).columns
    bad = {d for d, n, hit, _ in want if hit and 20 * hit >= n}
    assert [r["doc_id"] for r in rows(clean)] == [d for d, *_ in want if d not in bad] and bad
    nothing = decontamination.decontaminate(frame(spark, docs), benchmark.limit(0))
    assert nothing.count() == len(docs) and nothing.filter("contaminated").count() == 0


def test_one_block_of_the_benchmark_at_a_time(spark, monkeypatch):
    steps, take, write = [], decontamination.blocks, decontamination.stored

    def taken(windows):
        for part in take(windows):
            steps.append("take")
            yield part

    def written(df, name):
        out = write(df, name)
        steps.append(name)
        return out
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 12)
    monkeypatch.setattr(decontamination, "blocks", taken)
    monkeypatch.setattr(decontamination, "stored", written)
    benchmark = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(40)))], "item_id string, text string")
    docs = frame(spark, [(1, " ".join(f"w{i}" for i in range(40))), (2, "nothing of it")])
    got = rows(decontamination.decontaminate(docs, benchmark))
    assert [(r["doc_id"], r["n_hit"], r["contaminated"]) for r in got] == [(1, 40, True), (2, 0, False)]
    assert steps == ["benchmark_windows"] + ["take", "benchmark_hits"] * 3
    steps.clear()
    assert [r["doc_id"] for r in rows(decontamination.keep_clean(docs, benchmark))] == [2]
    assert steps.count("take") == 3


def test_lists_of_groups_count_for_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard_join, "BROADCAST_ROWS", 10)
    homes = spark.sql("SELECT id AS rk, sequence(1, 1) AS homes FROM range(10)")
    assert ngram_jaccard_join.small(homes)
    assert not ngram_jaccard_join.small(homes.selectExpr("rk", "sequence(1, 1000) AS homes").limit(2))


def test_licenses_of_odd_rows(spark):
    mit = license_scan.TEMPLATES[10][1]
    edited = mit.replace("free of charge", "wholly free of charge")
    docs = frame(spark, [(1, "x " * 40 + mit.upper() + " y" * 40), (2, edited), (3, None), (4, ""), (None, "Released under\nthe MIT   License!"),
                         (5, " ".join(mit.split()[:30])), (6, "released under the MIT"), (7, "word " * 50000), (1, "x " * 40 + mit.upper() + " y" * 40)])
    got = rows(license_scan.scan(docs))
    assert [(r["doc_id"], r["license"]) for r in got] == [(None, "MIT"), (1, "MIT"), (2, "MIT")]
    assert got[1]["contained"] == 1.0 and 0.8 <= got[2]["contained"] < 1.0
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    with pytest.raises(ValueError):
        license_scan.template_table(spark, [("a", "b")] * 2001)


def test_neighbouring_licenses_are_told_apart(spark):
    """Each notice by itself, in other words and with one word edited, and two next to each other."""
    notices = license_scan.TEMPLATES
    docs = [(i, "some words before " * 5 + text + " and some after it" * 5) for i, (_, text) in enumerate(notices)]
    gpl, agpl = (next(t for k, t in notices if k == name and "redistribute" in t) for name in ("GPL-2.0", "AGPL-3.0"))
    docs += [(900, gpl.replace("redistribute", "share")), (901, agpl.replace("option", "choice")), (902, f"{gpl} {agpl}")]
    got = {}
    for r in rows(license_scan.scan(frame(spark, docs))):
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {**{i: {name} for i, (name, _) in enumerate(notices)}, 900: {"GPL-2.0"}, 901: {"AGPL-3.0"}, 902: {"GPL-2.0", "AGPL-3.0"}}


def test_row_keys_ignore_other_columns(spark):
    assert keyed(frame(spark, [(1, "x")])).columns == ["doc_id", "text", "rk"]


def test_the_kept_copy_does_not_depend_on_the_layout(spark):
    """Rows equal in id and text but not in other columns: the same one stays for any number of partitions."""
    docs = [(1, "one two three four five", f"source {k}") for k in range(9)] + [(2, "one two three four five", "x"), (3, None, "y"), (3, None, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {str(sorted(map(str, ngram_jaccard_join.keep_one(df.repartition(n)).collect()))) for n in (1, 3, 5, 7)}
    assert len(got) == 1 and "source 0" in got.pop()


def test_a_window_that_very_many_items_share(spark, monkeypatch):
    """Its items are spread over blocks that are bounded by bytes; no row and no set holds them all."""
    shared = " ".join(f"w{i}" for i in range(13))
    benchmark = spark.range(20_000).select(F.concat(F.lit("item"), "id").alias("item_id"), F.lit(shared).alias("text"))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1 << 20)
    windows = decontamination.benchmark_windows(benchmark)
    parts = [sum(len(words) + sum(len(i) + 64 for i in items) for _, _, words, items in part) for part in decontamination.blocks(windows)]
    assert len(parts) >= 2 and max(parts) < 1.2 * (1 << 20)
    docs = [(1, shared + " tail"), (2, "none"), (1, shared + " tail"), (3, "x " + shared)]
    got = rows(decontamination.decontaminate(frame(spark, docs), benchmark))
    ids = hashlib.sha256(",".join(sorted(f"item{k}" for k in range(20_000))).encode()).hexdigest()
    assert [(r["doc_id"], r["n_hit"], r["n_items"]) for r in got] == [(1, 13, 20_000)] * 2 + [(2, 0, 0), (3, 13, 20_000)]
    assert {r["items_sha256"] for r in got if r["n_hit"]} == {ids}


def test_copies_of_a_document_are_merged_as_one(spark, monkeypatch):
    """With several blocks, the written hits hold each text once, however often it is there."""
    text = " ".join(f"w{i}" for i in range(40))
    written = []
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 12)
    monkeypatch.setattr(decontamination, "stored", lambda df, name, keep=decontamination.stored: written.append(keep(df, name)) or written[-1])
    benchmark = spark.createDataFrame([("a", text)], "item_id string, text string")
    got = rows(decontamination.decontaminate(frame(spark, [(1, text)] * 500 + [(2, "x")]), benchmark))
    assert [(r["doc_id"], r["n_hit"]) for r in got] == [(1, 40)] * 500 + [(2, 0)]
    assert all(df.count() <= 2 for df in written[1:]) and len(written) > 2


def test_odd_tables_of_decontamination(spark):
    benchmark = spark.createDataFrame([("a", "one two three " * 20_000)], "item_id string, text string")
    assert decontamination.decontaminate(frame(spark, []), benchmark).collect() == []
    assert decontamination.keep_clean(frame(spark, []), benchmark).collect() == []
    got = rows(decontamination.decontaminate(frame(spark, [(1, "zero " + "one two three " * 30_000), (None, None)]), benchmark))
    assert [(r["doc_id"], r["n_hit"], r["contaminated"]) for r in got] == [(None, 0, False), (1, 90_000, True)]


def test_a_phrase_with_ever_other_surroundings_is_spread(spark):
    """A phrase in all documents, other words around it in each: no task gets it all, and the result is exact."""
    rng = random.Random(8)
    candidates = [f"p{k} hot phrase of six words" for k in range(3000)]
    least = [W.sequence_hashes(words.hashes(0), 6) for _, _, words in W.word_blocks(pa.array(candidates), substring_dedup._TABLE)]
    phrase = candidates[int(np.argmin(np.concatenate(least)[::6]))]  # a seed that is the least of its windows
    texts = [" ".join([*(f"a{rng.randrange(10**6)}" for _ in range(30)), phrase, *(f"b{rng.randrange(10**6)}" for _ in range(30))]) for _ in range(4000)]
    texts += [texts[5], texts[6][:len(texts[6]) // 2 + 60]]
    docs = list(enumerate(texts))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        spots = substring_dedup.by_batch(keyed(frame(spark, docs)), substring_dedup.partial(
            substring_dedup._seeds, window=20, seed=6), substring_dedup._SPOT)
        hot = spots.groupBy("g").count().agg({"count": "max"}).first()[0]
        sizes = sorted(r["count"] for r in substring_dedup._ranked(spots).groupBy(F.spark_partition_id()).count().collect())
        assert hot > 1000 and len(sizes) == 40 and sizes[-1] < 3 * sizes[20]
        assert substring_dedup._several(spots).count() >= 1
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows(substring_dedup.remove_repeats(frame(spark, docs)))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == passages(docs) and sum(r[2] for r in got) > 60


def test_licenses_equal_the_sql_of_all_templates(spark):
    """Texts with every notice, whole, shortened, next to others and mixed, against the SQL without bands."""
    rng = random.Random(6)
    notices = [text for _, text in license_scan.TEMPLATES]
    docs = []
    for i in range(400):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(notices).split()
            cut = rng.choice([0, 0, 0, 1, len(words) // 10, len(words) // 5])
            parts.append(" ".join(words[:len(words) - cut] if rng.random() < 0.5 else words[cut:]))
            parts.append(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 40]))))
        docs.append((i, " ".join(parts)))
    own = duckdb.connect()
    own.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    own.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = sorted(own.execute(license_scan.OP2_SQL).fetchall())
    got = sorted((r["doc_id"], r["license"], r["first_word"], r["contained"]) for r in rows(license_scan.scan(frame(spark, docs))))
    assert len({r[1] for r in want}) > 15
    assert got == want
