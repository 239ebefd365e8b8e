"""Toxicity by multiple-instance learning: sentences are instances, documents are labelled bags.

A sentence's probability is a logistic function of its words; a document is toxic when one of its sentences is:
score = 1 - product over sentences of (1 - p), the noisy-or. Weights are fitted to document labels by the gradient of the
document likelihood, which reaches each sentence through the noisy-or, so the model learns which sentences offend.

Words are hashed to ``2 ** bits`` weights. The fit uses a bounded sample of labelled rows (``sample_docs`` distinct texts, the least by a hash
of the text, so it doesn't depend on order, and copies count once) of at most ``most_chars`` characters each and ``sample_chars`` in all; everything is scored, whole;
a very long text takes memory in proportion to itself.

Null and empty texts have no sentence: score 0. Rows that repeat score alike. Labels that are null are no labels; a document with several
labels is toxic if one says so. Ties at the end of the sample are settled by the least id. Other columns are ignored, also those that have the name of a result. With no positive or no negative label every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm import textops

ENDS = b".!?\n\r"
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def instances(buf: np.ndarray, off: np.ndarray, bits: int):
    """(features, the sentence of each, document of each sentence, byte span of each sentence).

    A word's features are itself and, if it is longer, its first ``PREFIXES`` bytes, which stand for stems.
    """
    low = textops.lower_table()[buf]
    starts, ends, first = textops.word_spans(low, off, textops.alnum_words())
    shift = np.uint64(64 - bits)
    features, sources = [(textops.word_hashes(low, starts, ends) >> shift).astype(np.int64)], [np.arange(len(starts))]
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        features.append(((textops.word_hashes(low, starts[longer], starts[longer] + n) + np.uint64(1)) * textops.M2 >> shift).astype(np.int64))
        sources.append(longer)
    stop = np.zeros(256, bool)
    stop[list(ENDS)] = True
    cuts = np.union1d(off, np.flatnonzero(stop[buf]) + 1)
    raw = np.searchsorted(cuts, starts, side="right") - 1
    used, sentence = np.unique(raw, return_inverse=True)
    a, b = cuts[used], cuts[np.minimum(used + 1, len(cuts) - 1)]
    return np.concatenate(features), sentence[np.concatenate(sources)], np.searchsorted(off, a, side="right") - 1, np.stack([a, b], 1)


def distinct_words(feature: np.ndarray, sentence: np.ndarray, bits: int):
    """Every feature once a sentence."""
    both = np.unique((sentence << bits) | feature)
    return both & ((1 << bits) - 1), both >> bits


def blocks(texts: list[str], most_chars: int = 1_000_000):
    """Slices of the list with about ``most_chars`` characters each, and one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most_chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str], labels: np.ndarray, *, bits: int, rounds: int, rate: float, l1: float, evidence: float = 20.0, start_bias: float = -6.0) -> Model:
    """Full-batch Adam on the noisy-or likelihood, with both classes given equal weight and proximal L1."""
    weights = np.zeros(1 << bits)
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(weights, -np.inf)
    n_docs, n_sent, parts = len(y), 0, []
    in_docs, in_toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for at in blocks(texts):  # so that the arrays of all texts never exist at once
        buf, off = textops.string_buffer(pa.array(texts[at], pa.large_string()))
        feature, sentence, doc, _ = instances(buf, off, bits)
        if not len(doc):
            continue
        feature, sentence = distinct_words(feature, sentence, bits)
        word_doc = np.unique((doc[sentence] << bits) | feature)
        word = word_doc & ((1 << bits) - 1)
        in_docs += np.bincount(word, minlength=1 << bits)
        in_toxic += np.bincount(word[y[at][word_doc >> bits] > 0], minlength=1 << bits)
        parts.append((feature.astype(np.int32), (sentence + n_sent).astype(np.int32), (doc + at.start).astype(np.int32)))
        n_sent += len(doc)
    if not parts:
        return Model(weights, -np.inf)
    doc = np.concatenate([x[2] for x in parts])
    # a feature has a weight if toxic documents have it significantly more often than others (a likelihood-ratio test)
    pos, neg = y.sum(), (1 - y).sum()
    rate_all, in_clean = pos / (pos + neg), in_docs - in_toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(in_toxic > 0, in_toxic * np.log(in_toxic / (in_docs * rate_all)), 0) + np.where(in_clean > 0, in_clean * np.log(in_clean / (in_docs * (1 - rate_all))), 0))
    odds = np.log((in_toxic + 0.5) / (pos + 1)) - np.log((in_clean + 0.5) / (neg + 1))
    live = (odds > 0) & (np.nan_to_num(gain) >= evidence)
    weights = np.where(live, np.clip(odds, 0, 4), 0.0)
    feature, sentence = (np.concatenate([x[k][live[x[0]]] for x in parts]) for k in (0, 1))
    del parts
    bias, cost = start_bias, np.where(y > 0, 0.5 / pos, 0.5 / neg) * n_docs
    m = np.zeros(len(weights) + 1)
    v = np.zeros(len(weights) + 1)
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(sentence, weights[feature], n_sent) + bias)
        keep = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs)
        whole = np.clip(1 - np.exp(keep), 1e-9, 1)
        ds = np.where(y > 0, -cost * (1 - whole) / whole, cost)[doc] * p / n_docs
        g = np.append(np.bincount(feature, ds[sentence], len(weights)), ds.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= step[-1]
        weights = weights - step[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * l1, 0)
    return Model(weights, float(bias))


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str, text_col: str, label_col: str, sample_docs: int, sample_chars: int, most_chars: int):
    """(texts, labels) of a bounded share of the labelled rows, the same whatever their order. Half the rows at most are of one class; longer ones than ``most_chars`` aren't taken, so that none fills the sample alone."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    texts = docs.where(allowed).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, most_chars))
    rows = texts.select("id", F.xxhash64("text").alias("h"), F.length("text").cast("bigint").alias("n")).join(marks, "id")  # no text is shuffled
    least = Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    ids = []
    for y in (1, 0):
        distinct = rows.where((F.col("y") > 0) == F.lit(y == 1)).groupBy("h").agg(F.min("id").alias("id"), F.max("n").alias("n"))
        some = distinct.orderBy("h", "id").limit(sample_docs // 2)
        ids += [(r.id, r.h, y) for r in some.withColumn("sum", F.sum("n").over(least)).where(F.col("sum") <= sample_chars // 2).select("id", "h").collect()]
    if not ids:
        return [], np.zeros(0)
    chosen = docs.sparkSession.createDataFrame(ids, f"id {docs.schema[id_col].dataType.simpleString()}, h bigint, y int")  # at most sample_docs ids
    found = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "h"]).groupBy("h", "y").agg(F.min("text").alias("text"))
    picked = sorted((r.text, r.y) for r in found.select("text", "y").collect())
    return [t for t, _ in picked], np.array([y for _, y in picked], float)


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", bits: int, keep: tuple[Column, ...] = (), threshold=0.7, sentences=False) -> DataFrame:
    """Per row: id, score, predicted and, with ``sentences``, the offending ones as (start byte, end byte, p), where p >= 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch in textops.sliced(batches, "text"):
            buf, off = textops.string_buffer(batch["text"])
            feature, sentence, doc, span = instances(buf, off, bits)
            feature, sentence = distinct_words(feature, sentence, bits) if len(feature) else (feature, sentence)
            p = sigmoid(np.bincount(sentence, model.weights[feature], len(doc)) + model.bias) if len(doc) else np.zeros(0)
            whole = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), batch.num_rows)) if len(doc) else np.zeros(batch.num_rows)
            whole = np.clip(np.round(whole, 9), 0, 1)
            out = [batch["id"], pa.array(whole), pa.array((whole >= threshold).astype(np.int32))]
            names = ["id", "score", "predicted"]
            if sentences:
                found = [[] for _ in range(batch.num_rows)]
                for k in np.flatnonzero(p >= 0.5):
                    found[doc[k]].append({"start": int(span[k, 0] - off[doc[k]]), "end": int(span[k, 1] - off[doc[k]]), "p": float(p[k])})
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
                names.append("sentences")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {kind}, score double, predicted int" + (", sentences array<struct<start:bigint,end:bigint,p:double>>" if sentences else "")
    return textops.in_small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col="doc_id", text_col="text", label_col="toxic", sample_docs=6000, sample_chars=30_000_000, most_chars=200_000, bits=18, rounds=120, rate=0.1, l1=0.002, evidence=20.0) -> Model:
    """A model from the labelled rows where ``allowed`` holds."""
    texts, y = sample(docs, labels, allowed, id_col=id_col, text_col=text_col, label_col=label_col, sample_docs=sample_docs, sample_chars=sample_chars, most_chars=most_chars)
    return fit(texts, y, bits=bits, rounds=rounds, rate=rate, l1=l1, evidence=evidence)
