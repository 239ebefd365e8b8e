"""Toxicity and language identification: held-out accuracy, leaks, and defined edges."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import language, textops, toxicity

CLEAN = [f"word{k}" for k in range(200)]
BAD = ["vile", "rotten", "nasty"]


def sentence(r, bad=False):
    w = r.choices(CLEAN, k=r.randint(4, 9))
    if bad:
        w[r.randrange(len(w))] = r.choice(BAD)
    return " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def toxic(spark):
    r, docs, labels = random.Random(7), [], []
    for i in range(400):
        y = int(r.random() < 0.3)
        s = [sentence(r) for _ in range(r.randint(2, 8))]
        if y:
            s[r.randrange(len(s))] = sentence(r, True)
        docs.append((i, " ".join(s), "x"))
        labels.append((i, y))
    docs.append((400, ("word1 word2. " * 200_000), "x"))  # longer than a sample row may be
    labels.append((400, 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def remainder(n):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def test_toxicity_held_out(toxic):
    docs, labels, truth = toxic
    model = toxicity.train(docs, labels, remainder(3) != 1)
    rows = toxicity.score(docs, model, bits=18, sentences=True).withColumn("held", remainder(3) == 1).collect()
    held = [r for r in rows if r.held]
    assert len(rows) == 401 and len(held) > 80
    assert np.mean([(r.score >= 0.7) == bool(truth[r.doc_id]) for r in held]) > 0.95
    texts = dict(docs.select("doc_id", "text").collect())
    found = [(texts[r.doc_id].encode()[s.start : s.end].decode(), s.p) for r in held if truth[r.doc_id] for s in r.sentences]
    assert found and all(any(w in t.lower() for w in BAD) for t, _ in found)  # the sentences that offend, and no others
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_never_sees_held_out_labels(spark, toxic):
    docs, labels, _ = toxic
    flipped = labels.withColumn("toxic", F.when(remainder(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x, remainder(3) != 1) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_edges(spark, toxic):
    docs, labels, _ = toxic
    model = toxicity.train(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (2, "...", "c"), (3, "vile", "d"), (3, "vile", "d")], "doc_id bigint, text string, predicted string")
    rows = sorted(((r.doc_id, r.score, r.predicted) for r in toxicity.score(odd, model, bits=18).collect()), key=str)
    assert [x for x in rows if x[0] != 3] == [(1, 0.0, 0), (2, 0.0, 0), (None, 0.0, 0)] and rows[2] == rows[3]
    assert toxicity.score(odd.limit(0), model, bits=18).collect() == []
    none = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.score(odd, none, bits=18).collect()} == {0.0}
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.train(docs, nulls, F.lit(True)), bits=18).collect()} == {0.0}


SOUNDS = {"de": ["schaft", "ung", "keit", "der", "über"], "en": ["the", "thing", "with", "ought", "wh"], "es": ["ción", "que", "ñ", "los", "ado"], "fr": ["ement", "eau", "les", "ç", "quoi"]}


@pytest.fixture(scope="module")
def spoken(spark):
    r, rows = random.Random(3), []
    for i in range(480):
        lang = sorted(SOUNDS)[i % 4]
        text = " ".join("".join(r.choices(SOUNDS[lang], k=r.randint(1, 3))) for _ in range(r.randint(5, 60)))
        rows.append((i, text, lang if i % 11 else None, "s"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")


def test_language_held_out(spoken):
    model = language.train(spoken, remainder(4) != 2)
    assert model.languages == ["de", "en", "es", "fr"] and model.families == ["germanic", "romance"]
    rows = language.predict(spoken, model).withColumn("held", remainder(4) == 2).collect()
    names = sorted(SOUNDS)
    assert len(rows) == 480
    assert np.mean([r.lang_pred == names[r.doc_id % 4] for r in rows if r.held]) > 0.97


def test_language_never_sees_held_out_rows(spoken):
    other = spoken.withColumn("lang", F.when(remainder(4) == 2, "en").otherwise(F.col("lang")))
    a, b = (language.train(x, remainder(4) != 2) for x in (spoken, other))
    assert (a.weights == b.weights).all() and (a.bias == b.bias).all()


def test_language_edges(spark, spoken):
    model = language.train(spoken, F.lit(True))
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 34 !?"), (3, "der"), (4, "x"), (5, "語"), (5, "語")], "doc_id bigint, text string")
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert {x for x in rows if x[0] in (None, 1, 2)} == {(None, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)}
    assert len(rows) == 6 and all(x[1] != "und" and 0 <= x[2] <= 1 for x in rows if x[0] in (3, 4, 5))
    assert language.predict(odd.limit(0), model).collect() == []
    nothing = language.train(spoken.where("lang is null"), F.lit(True))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    one = language.train(spoken.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in language.predict(odd.where("doc_id > 2"), one).collect()} == {"de"}


def test_language_keeps_columns_and_whole_texts(spark, spoken):
    model = language.train(spoken, F.lit(True))
    long = "der " * 300_000 + "the " * 10
    df = spark.createDataFrame([(1, long, "en", 7)], "doc_id bigint, text string, lang string, k0 int")
    (r,) = language.predict(df, model, keep=("lang", "k0", "text")).collect()
    assert (r.lang_pred, r.lang, r.k0, r.text) == ("de", "en", 7, long)


def test_copies_of_a_third_of_all_rows(spark, spoken):
    hot = spark.createDataFrame([(10_000 + k, "der schaft über", "de", "s") for k in range(240)], spoken.schema)
    model = language.train(spoken.union(hot), F.lit(True), per_language=100)
    assert {r.lang_pred for r in language.predict(hot, model).collect()} == {"de"}


def word_hash(word: bytes) -> int:
    return int(textops.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def plain_toxicity(model, text, bits=18):
    """(score, offending sentences) of one text: sentences, words, their first bytes, and the noisy-or, one by one."""
    raw, clean, bad, at = (text or "").encode(), 1.0, [], 0
    for part in re.findall(rb"[^.!?\n\r]*[.!?\n\r]|[^.!?\n\r]+$", raw):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in part))
        features = {word_hash(w) >> (64 - bits) for w in words}
        for n in toxicity.PREFIXES:
            features |= {(((word_hash(w[:n]) + 1) * int(textops.M2)) % 2**64) >> (64 - bits) for w in words if len(w) > n}
        if words:
            p = 1 / (1 + math.exp(-min(40, max(-40, sum(model.weights[f] for f in features) + model.bias))))
            clean *= 1 - p
            if p >= 0.5:
                bad.append((at, at + len(part)))
        at += len(part)
    return 1 - clean, bad


def test_toxicity_equals_plain_scores(spark, toxic):
    docs, labels, _ = toxic
    model = toxicity.train(docs, labels, remainder(3) != 1)
    odd = [(1000, None), (1001, ""), (1002, "Vile! Rotten? né vileness.\r\nword1"), (1003, "..vile"), (1004, "no end vile words")]
    rows = spark.createDataFrame(odd, "doc_id bigint, text string").unionByName(docs.where("doc_id < 60").select("doc_id", "text"))
    texts = dict(rows.collect())
    for r in toxicity.score(rows, model, bits=18, sentences=True).collect():
        score, bad = plain_toxicity(model, texts[r.doc_id])
        assert abs(r.score - score) < 1e-6 and [(x.start, x.end) for x in r.sentences] == bad, r.doc_id


def test_samples_take_copies_once(spark):
    rows = [(i, f"text number {i} of many words", i % 2) for i in range(200)] + [(1000 + i, "the same vile text", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    texts, y = toxicity.sample(docs, docs, F.lit(True), id_col="doc_id", text_col="text", label_col="toxic", sample_docs=80, sample_chars=10**6, most_chars=1000)
    assert len(texts) == len(set(texts)) == 80 and y.sum() == 40
    spoken = docs.withColumn("lang", F.when(F.col("toxic") == 1, "en").otherwise("fr"))
    texts, langs = language.sample(spoken, F.lit(True), text_col="text", lang_col="lang", per_language=50, sample_rows=80, sample_chars=80 * 12, most_languages=5)
    assert len(texts) == 80 and langs.count("en") == 40 and max(map(len, texts)) == 12


def plain_language(model, text, bits=13):
    """(language, score) of one text: trigrams, margins, the family, then votes with ties by margins."""
    b = [c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()]
    grams = [x for x in zip(b, b[1:], b[2:]) if x != (32, 32, 32)]
    code = [((x | y << 8 | z << 16) * 2654435761 % 2**32) >> (32 - bits) for x, y, z in grams]
    margin = {t: sum(float(model.weights[c, k]) for c in code) / max(1, len(code)) + model.bias[k] for k, t in enumerate(model.tasks)}
    sure, fam = 1.0, model.families[0]
    if len(model.families) > 1:
        order = sorted(model.families, key=lambda f: -margin["family", f])
        fam, sure = order[0], 1 / (1 + math.exp(-2 * (margin["family", order[0]] - margin["family", order[1]])))
    own = [x for x in model.languages if language.family(x) == fam]
    side = {(a, c): margin["pair", a, c] if ("pair", a, c) in margin else -margin["pair", c, a] for a in own for c in own if a != c}
    best = max(own, key=lambda a: (sum(side[a, c] > 0 for c in own if c != a), sum(side[a, c] for c in own if c != a)))
    if len(own) > 1:
        sure *= 1 / (1 + math.exp(-2 * min(side[best, c] for c in own if c != best)))
    return best, sure


def test_language_equals_plain_votes(spark, spoken):
    model = language.train(spoken, remainder(4) != 2)
    more = [(1000, "Der ÜBER-thing, que?"), (1001, "a"), (1002, "eau " * 50_000), (1003, "x1y2\n\nz3 les")]
    rows = spark.createDataFrame(more, "doc_id bigint, text string").unionByName(spoken.where("doc_id < 100").select("doc_id", "text"))
    texts = dict(rows.collect())
    for r in language.predict(rows, model).collect():
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, (r, lang, score)


def test_language_fit_is_bounded_and_still_right(spark, spoken):
    """With a tenth of the cells the matrix keeps only the features that vary most."""
    texts, langs = language.sample(spoken, remainder(4) != 2, text_col="text", lang_col="lang", per_language=800, sample_rows=4000, sample_chars=8_000_000, most_languages=200)
    model = language.fit(texts, langs, bits=13, cells=len(texts) * 800)
    assert np.count_nonzero(np.abs(model.weights).sum(1)) <= 800
    rows = language.predict(spoken, model).withColumn("held", remainder(4) == 2).collect()
    assert np.mean([r.lang_pred == sorted(SOUNDS)[r.doc_id % 4] for r in rows if r.held]) > 0.97
