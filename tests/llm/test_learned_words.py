"""The words of operator 5's dictionary are counted over all texts, whole; copies count once."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from keyloom.llm import queries as llm
from keyloom.llm import secrets


def plain(texts) -> tuple[str, ...]:
    seen = Counter()
    for t in {x for x in texts if x is not None}:
        seen.update({w for w in re.findall("[a-z0-9]+", t.lower()) if re.fullmatch("[a-z]{4,20}", w)})
    return tuple(w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n > 1)[:3000]


@pytest.fixture(scope="module")
def corpus():
    """More texts than a sample would hold, two of them long with a word of their own at the end; large groups of copies; letters of a key in two texts."""
    r = random.Random(5)
    names = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 22))) for _ in range(900)]
    texts = [" ".join(r.choices(names, k=r.randint(1, 12))).title() for _ in range(2600)]
    texts += ["once alone " * 3] * 700 + [texts[0]] * 40 + [None, "", None]
    return [*texts, "padding " * 6000 + "zebrafinch", "filling " * 6000 + "Zebrafinch 9abcdefg8", "x9abcdefg8 key"]


def test_words_come_from_all_texts_whole(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(secrets, "LONG", 10_000)
    got = secrets.train(docs)
    assert got == plain(corpus) and "zebrafinch" in got and "alone" not in got and "abcdefg" not in got
    monkeypatch.setattr(secrets.textops, "small", lambda rows: rows)
    monkeypatch.setattr(secrets, "MOST_HELD", 10)
    assert secrets.train(docs.coalesce(2)) == got


def test_the_query_learns_from_all_texts(spark, corpus, tmp_path, monkeypatch):
    spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given, scan = [], secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda *a, **k: given.append(k["words"]) or scan(*a, **k))
    llm.op5_secret_scans(spark, str(tmp_path))
    assert given == [plain(corpus)]


def test_the_pipeline_learns_from_all_texts(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(corpus)], "doc_id bigint, text string, n_chars int")
    given, scan = [], secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda *a, **k: given.append(k["words"]) or scan(*a, **k))
    corpus_pipeline.secret_scan(spark, docs, "")
    assert given == [plain(corpus)]


def test_every_learned_word_counts_whatever_its_rank(spark):
    """Names made of learned words stay as they are, those of the commonest ones as well; random keys go all the same."""
    r = random.Random(6)
    parts = [a + b + c for a in "bcdfghklmnprstvw" for b in "aeiou" for c in ("", "", "n", "r", "s", "t")]
    names = list(dict.fromkeys("".join(r.choices(parts, k=r.randint(2, 5))) for _ in range(6000)))
    names = [w for w in names if 4 <= len(w) <= 20][:3000]
    texts = [f"{k} " + " ".join(names[: 3000 - 70 * max(0, k - 1)]) for k in range(40)]
    readable = ["key: " + "_".join(names[k : k + 4]) + "_2" for k in range(0, 3000, 20)]
    keys = ["key: A1" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in range(20, 70)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate([*texts, *texts[-1:], *readable, *keys])], "doc_id bigint, text string, n_chars int")
    assert set(secrets.train(docs)) == set(names)
    out = {x.doc_id: x.text for x in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    first = len(texts) + 1
    found = [k for k, t in enumerate(readable) if out[first + k] != t]
    assert len(found) <= 7, found
    assert [out[first + len(readable) + k] for k in range(len(keys))] == [f"key: {corpus_pipeline.SECRET_MARK}"] * len(keys)
