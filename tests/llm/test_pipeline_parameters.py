"""The stage of near duplicates names its own parameters."""

import corpus_pipeline


def test_near_duplicates_name_shingle_and_percent(monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline.ngram_jaccard_join, "keep_one", lambda *given: seen.append(given))
    corpus_pipeline.near_duplicates(None, "docs", "folder")
    assert seen == [("docs", 4, 85)]
