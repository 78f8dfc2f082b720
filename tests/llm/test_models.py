"""Language identification and the quality classifier: held-out accuracy and odd rows."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import frame, rows
from tidemark.llm import language_id, quality_classifier
from tidemark.llm.tables import documents, keyed, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learnt(spark):
    return (language_id.op8_language_id(spark, SF).toPandas().set_index("doc_id"),
            quality_classifier.op9_quality_classifier(spark, SF).toPandas().set_index("doc_id"))


def test_language_of_held_out_rows(spark, learnt):
    docs = documents(spark, SF).select("doc_id", "lang").toPandas().set_index("doc_id")
    got = learnt[0].join(docs)
    assert len(got) == len(docs)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got["held_out"].items())
    assert (got[got["held_out"]]["lang_pred"] == got[got["held_out"]]["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_quality_of_held_out_rows(spark, learnt):
    labels = table(spark, SF, "labels").toPandas().set_index("doc_id")
    got = learnt[1].join(labels)
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    test = got[got["held_out"] & got["quality"].notna()]
    assert (test["predicted"] == test["quality"]).mean() > 0.93
    assert test[test["quality"] == 1]["predicted"].mean() > 0.95


def test_backoff_goes_to_shorter_grams():
    model = language_id.Model([("aa", "thing", 9), ("aa", "sing", 5), ("bb", "ñoro", 7), ("bb", "cielo", 3)])
    assert model.predict("thing")[0] == "aa" and model.predict("things")[0] == "aa"
    assert model.predict("ñ")[0] == "bb" and model.predict("loro")[0] == "bb"
    assert model.predict("123 !?") == model.predict(None) == model.predict("") == ("und", 0.0)
    known = model.word("xthingx")
    want = np.mean([model.gram_table[model.grams[g]] for g in language_id.grams("xthingx", 5) if g in model.grams], axis=0)
    assert np.allclose(known, want - language_id.STEP_DOWN)
    assert model.predict("жж") == ("aa", 0.5)


def test_remembered_words_change_nothing(monkeypatch):
    counts = [("aa", "thing", 9), ("aa", "sing", 5), ("bb", "ñoro", 7), ("bb", "cielo", 3)]
    texts = [" ".join(f"{a}{b}" for a in ("thi", "oro", "x") for b in ("ng", "elo", k)) for k in ("a", "o", "thing", "q")] * 3
    first = language_id.Model(counts)
    want = [language_id.Model(counts).predict(t) for t in texts]
    assert [first.predict(t) for t in texts] == want
    monkeypatch.setattr(language_id, "CACHE", 5)
    few = language_id.Model(counts)
    assert [few.predict(t) for t in texts] == want and len(few.seen) < 30


def test_language_of_odd_rows(spark):
    docs = frame(spark, [(1, "the thing is", "en"), (3, "la cosa es", "es"), (5, None, "en"), (None, "the thing", "en"), (7, "la cosa", None),
                         (7, "la cosa", None), (8, "", "es"), (9, "the " * 50000, None)])
    got = rows(language_id.identify(docs))
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [
        (None, "en"), (1, "en"), (3, "es"), (5, "und"), (7, "es"), (7, "es"), (8, "und"), (9, "en")]
    assert rows(language_id.identify(docs.filter("doc_id = 7")))[0]["lang_pred"] == "und"
    assert language_id.identify(docs.limit(0)).count() == 0


def test_a_rare_language_keeps_its_words_and_grams(spark, monkeypatch):
    """Two large languages of more words than are kept, and one of a few documents whose words are unique."""
    monkeypatch.setattr(language_id, "WORDS", 300)
    big = {lang: ["".join(p) for p in itertools.product(heads, vowels, ends, vowels)]
           for lang, heads, vowels, ends in (("aa", "bdgklmnp", "aei", "rstvz"), ("bb", "bcfhjkqw", "ouy", "ndgmx"))}
    data = [(100 * k + i, " ".join(words[i % 3:] + words), lang) for k, (lang, words) in enumerate(big.items()) for i in range(40)]
    rare = [f"žu{a}š{b}ćo" for a in "aeiou" for b in "ptkbdgmnrl"]
    data += [(1001, " ".join(rare[:20]), "cc"), (1003, " ".join(rare[20:40]), "cc")]
    docs = frame(spark, [*data, (1005, " ".join(rare[40:]), None), (1006, " ".join(big["aa"][:9]), None), (1007, " ".join(big["bb"][-9:]), None)])
    model = language_id.learn(docs)
    assert model.languages == ["aa", "bb", "cc"]
    assert sum(w in model.words for w in rare) == sum(w in " ".join(t for i, t, _ in data if zlib.crc32(str(i).encode()) % 4 != 2) for w in rare)
    assert [model.predict(" ".join(x))[0] for x in (rare[40:], big["aa"][:9], big["bb"][-9:])] == ["cc", "aa", "bb"]
    # N-grams come from all words, also from those that are not kept.
    assert any(w not in model.words for w in big["aa"]) and all(g in model.grams for w in big["aa"] for g in language_id.grams(w, 3))
    got = {r["doc_id"]: r["lang_pred"] for r in rows(language_id.identify(docs))}
    assert (got[1005], got[1006], got[1007]) == ("cc", "aa", "bb")


@pytest.mark.parametrize("length", [1, 40, 41, 44, 45, 79, 80, 81, 163, 1000])
def test_pieces_of_a_run_hold_each_gram_once(length):
    run = "".join(chr(97 + i * i % 23) for i in range(length))
    words = language_id.words_of(f"1 {run}.")
    for order in language_id.ORDERS:
        padded = f" {run} " if order > 1 else run
        want = [padded[i:i + order] for i in range(len(padded) - order + 1)]
        assert Counter(g for w, n in words.items() for g in language_id.grams(w, order) * n) == Counter(want)


def test_the_whole_of_a_long_run_counts(spark):
    first, rest = "thesingthing" * 4, "ñorocieloñu" * 30
    docs = frame(spark, [(1, "thesingthing sing thing the", "en"), (3, "ñorocieloñu cielo ñoro ñu", "es"), (1001, first + rest, None),
                         (1003, "xxx" + rest[:60] + "yyy", "es"), (1004, rest[:30] + first * 8, None)])
    model = language_id.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in rows(language_id.identify(docs))}
    assert got[1001] == "es" and got[1004] == "en"
    long_run = language_id.words_of("xxx" + rest[:60] + "yyy")
    assert len(long_run) == 2 and all(w in model.words for w in long_run)


def test_the_risk_stays_non_negative():
    """Against plain logistic learning on true labels, from positives and unlabelled rows only."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (3000, 3)), rng.normal(-1.5, 1, (3000, 3))
    unlabelled = np.concatenate([good[:1400], bad[:600]])
    scorer = quality_classifier.fit(good[2000:], unlabelled, 0.7)
    assert (scorer(good[1400:2000]) >= 0.5).mean() > 0.95 and (scorer(bad[600:]) < 0.5).mean() > 0.95


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [(1, None), (None, "x"), (3, "a b c. " * 30000), (4, "some words here."), (4, "some words here."), (5, "")])
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, 1, 0, "x"), (99, 1, 1, "y"), (None, 1, 1, "y"), (5, None, 0, "z"), (3, 0, 0, "t")],
                                   "doc_id long, quality int, toxic int, text string")
    got = rows(quality_classifier.score(docs, labels))
    assert len(got) == 6 and got[3] == got[4] and all(0 <= r["score"] <= 1 for r in got)
    assert rows(quality_classifier.score(docs, labels.limit(0)))[0]["score"] == 0.5
    assert quality_classifier.score(docs.limit(0), labels).count() == 0
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r["predicted"] for r in got)


# ---- language by plain sums of log frequencies --------------------------------------------

SPOKEN = {
    "hi": "यह किताब मेरी है और मैं हिन्दी में लिखता हूँ", "th": "ภาษาไทย เป็น ภาษา ที่ สวยงาม", "ar": "اللُّغَةُ العَرَبِيَّةُ جميلة جدا",
    "en": "the book is on the table and the cat is under it", "de": "das Buch liegt auf dem Tisch und die Katze schläft"}


def plain_language(training, text):
    """Language and probability by the docstring: counts in dictionaries, logs summed word by word."""
    import math
    counts = {}
    for lang, t in training:
        for word, n in language_id.words_of(t).items():
            for kind, keys in [(0, [word]), *((o, language_id.grams(word, o)) for o in language_id.ORDERS)]:
                for k in keys:
                    per = counts.setdefault(kind, {}).setdefault(k, {})
                    per[lang] = per.get(lang, 0) + n
    languages = sorted({lang for lang, _ in training})
    total = {(kind, x): sum(per.get(x, 0) for per in keys.values()) for kind, keys in counts.items() for x in languages}

    def log_frequency(kind, key, lang):
        least = language_id.SMOOTH / max(total[kind, x] for x in languages)
        return math.log((counts[kind][key].get(lang, 0) / max(total[kind, lang], 1) + least) / (1 + least * len(counts[kind])))

    words = language_id.words_of(text or "")
    if not words:
        return "und", 0.0
    score = dict.fromkeys(languages, 0.0)
    for word, n in words.items():
        for lang in languages:
            if word in counts[0]:
                score[lang] += n * log_frequency(0, word, lang)
                continue
            for step, order in enumerate(language_id.ORDERS, 1):
                found = [g for g in language_id.grams(word, order) if g in counts.get(order, {})]
                if found:
                    score[lang] += n * (sum(log_frequency(order, g, lang) for g in found) / len(found) - language_id.STEP_DOWN * step)
                    break
    best = min(languages, key=lambda x: (-score[x], x))
    return best, 1 / sum(math.exp(min(score[x] - score[best], 0)) for x in languages)


def test_language_equals_plain_sums(spark):
    """The whole query path against sums in plain Python: known and unseen words, marks, texts without letters."""
    rng = random.Random(5)
    docs = []
    for i in range(160):
        lang = rng.choice(list(SPOKEN))
        words = SPOKEN[lang].split()
        docs.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), lang))
    unseen = ["tables bookish", "Tischen Bücher", "किताबें", "ภาษาอังกฤษ", "xq zzz", "½ ² ① Ⅷ", "12 34", "", "़", "½cat", "é" * 90, "the 	Katze"]
    docs += [(1000 + k, t, None) for k, t in enumerate(unseen)] + [(None, "the cat", "en"), (2000, None, "en")]
    training = [(lang, t) for i, t, lang in docs if lang and t is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    got = rows(language_id.identify(frame(spark, docs)))
    want = {i: plain_language(training, t) for i, t, _ in docs}
    assert len(got) == len(docs)
    for r in got:
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6), (r, lang, score)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1005, 1006, 1007, 1008)} == {"und"}


@pytest.mark.parametrize("text, words", [
    ("½ ² ① Ⅷ ٣ 12 _", []), ("हिन्दी में", ["हिन्दी", "में"]), ("العَرَبِيَّة", ["العَرَبِيَّة"]), ("a1b", ["a", "b"]), ("e\u0301t\u0301", ["e\u0301t\u0301"]), ("\u0301a", ["a"])])
def test_letters_and_marks(text, words):
    assert list(language_id.words_of(text)) == words


# ---- the classifier's risk ----------------------------------------------------------------

def test_gradient_of_the_risk(monkeypatch):
    """One step of Adam moves each weight by the rate against the sign of the numeric derivative of the risk."""
    Q = quality_classifier
    rng = np.random.default_rng(0)
    xp, xu = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (90, 5))
    for prior in (0.2, 0.9):  # the negative part of the risk is positive, and negative
        monkeypatch.setattr(Q, "STEPS", 0)
        before = Q.fit(xp, xu, prior)
        monkeypatch.setattr(Q, "STEPS", 1)
        after = Q.fit(xp, xu, prior)

        def parts(w):
            s = Q.Scorer(before.mean, before.scale, w)
            p, u = s(xp), s(xu)
            return prior * -np.log(p).mean(), -np.log(1 - u).mean() + prior * np.log(1 - p).mean()

        positive, negative = parts(before.weights)
        risk = (lambda w: sum(parts(w))) if negative >= 0 else (lambda w: -parts(w)[1])
        checked = 0
        for k, w in enumerate(before.weights):
            for at in list(np.ndindex(w.shape))[:12]:
                moved = [x.copy() for x in before.weights], [x.copy() for x in before.weights]
                moved[0][k][at] += 1e-5
                moved[1][k][at] -= 1e-5
                slope = (risk(moved[0]) - risk(moved[1])) / 2e-5 + Q.DECAY * w[at]
                if abs(slope) > 1e-4:
                    checked += 1
                    assert np.sign(before.weights[k][at] - after.weights[k][at]) == np.sign(slope), (prior, k, at, slope)
        assert checked > 20


def test_many_copies_of_a_row_stay_within_the_bound(spark):
    """Copies share a hash; what comes to the driver is cut before."""
    docs = keyed(frame(spark, [(1, "copy of a row")] * 3000 + [(i, f"text {i}") for i in range(2, 60)]))
    sizes = [len(quality_classifier._sample(docs, 60, 50, salt)) for salt in range(4)]
    assert max(sizes) == 50 and sizes[0] == len(quality_classifier._sample(docs.repartition(7), 60, 50, 0))
