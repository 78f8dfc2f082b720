"""BPE against the tokenizers library, and round trips."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import frame, rows
from tidemark.llm import bpe
from tidemark.llm.tables import hex256

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


ODD = st.lists(st.one_of(st.text(max_size=8), st.sampled_from(
    ["<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "don't", "'LL", "é", "日本", "🙂", "0½²", "aaaaaaaa", "<|endof", "​", "١٢"])), max_size=12).map("".join)


@settings(max_examples=800, deadline=None)
@given(ODD)
def test_equals_the_library(library, text):
    own = bpe.codec(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decodes_any_ids(library, ids):
    assert bpe.codec(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, sf, library):
    got = {r["doc_id"]: r for r in bpe.op6_bpe(spark, sf).collect()}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hex256(",".join(map(str, ids)).encode())
        assert got[doc_id]["decoded_sha256"] == hex256(text.encode())


def test_odd_rows(spark, library):
    long = "ab" * 60000 + " word" * 50000
    docs = frame(spark, [(1, None), (None, ""), (2, long), (2, long)])
    got = rows(bpe.encode(docs))
    assert [(r["doc_id"], r["ids"]) for r in got] == [(None, []), (1, [])] + [(2, library.encode(long, add_special_tokens=False).ids)] * 2
    assert bpe.encode(docs.limit(0)).count() == 0


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    own = bpe.Codec(PATH)
    words = [f"w{i}" for i in range(200)]
    assert own.encode(" ".join(words)) == bpe.codec(PATH).encode(" ".join(words))
    assert len(own.young) <= 10 and len(own.old) <= 10
