"""Language identification by hierarchical discrimination.

First a linear support vector machine for each language family (against the others) picks the family; then one-versus-one
linear machines separate the languages within it, by votes and, on a tie, by the sum of margins; where margins of families tie, the first by name
is taken. Features are the relative frequencies of byte trigrams of the whole lower-cased text (everything but letters is a space), hashed to
``2 ** bits``. Every text is scored whole, in place, however long it is.

Machines are fitted on the driver to a bounded sample: at most ``sample_rows`` distinct texts, shared equally by the ``most_languages`` commonest languages
(``per_language`` each at most), the least by a hash of the text. Of a text that is longer than its share of ``sample_chars`` one stretch of that length is
taken, at a place that the hash tells. The matrix has ``cells`` entries at most: with many rows, only the features that vary most. So the
driver's memory has one bound, whatever the number of languages.

Texts that are null or have no letter are ``und`` with score 0; so are all texts if there was nothing to learn from. With a
single language that language is the answer. Repeated rows get equal results. An empty table gives an empty result. Other columns are ignored or, with ``keep``, passed on.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm import textops

# Families of common languages by ISO 639-1 code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa sa ur",
    "semitic": "am ar he mt",
}


def family(language: str) -> str:
    return next((k for k, v in FAMILIES.items() if language in v.split()), language)


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    tasks: list[tuple]  # ("family", name) or ("pair", language, language)
    weights: np.ndarray  # a column for each task; the last row is for positions that don't count
    bias: np.ndarray


def grams(col, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram at every byte, offsets); positions across texts or of white space alone have the value 2**bits."""
    buf, off = textops.string_buffer(pc.utf8_lower(col))
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    b = table[buf].astype(np.uint32)
    n = len(b)
    out = np.full(n, 1 << bits, np.int32)
    if n > 2:
        key = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        h = (key * np.uint32(2654435761)) >> np.uint32(32 - bits)
        out[:-2] = np.where(key == 0x202020, 1 << bits, h)
        for back in (1, 2):
            at = off[1:] - back
            out[at[at >= 0]] = 1 << bits
    return out, off


def frequencies(text: str, bits: int) -> np.ndarray:
    """Relative trigram frequencies of a text."""
    g, _ = grams(pa.array([text], pa.large_string()), bits)
    x = np.bincount(g, minlength=(1 << bits) + 1)[:-1].astype(np.float64)
    return x / max(1, x.sum())


def svm(parts: list[np.ndarray], y: np.ndarray, rounds=150, ridge=1e-4, rate=1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the squared hinge, both classes with equal weight. The rows come in parts, so that none is copied."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    top = max(float(np.einsum("ij,ij->i", p, p).max()) for p in parts if len(p)) + 1
    at = np.cumsum([0, *map(len, parts)])
    w, b, wv, bv = np.zeros(parts[0].shape[1]), 0.0, np.zeros(parts[0].shape[1]), 0.0
    step = rate / (2 * top)
    for t in range(rounds):
        w32 = wv.astype(np.float32)
        slack = np.maximum(0, 1 - y * (np.concatenate([p @ w32 for p in parts]) + bv))
        g = share * slack * y * 2
        g32 = g.astype(np.float32)
        nw = wv + step * (sum(g32[at[k] : at[k + 1]] @ p for k, p in enumerate(parts)) - ridge * wv)
        nb = bv + step * g.sum()
        k = t / (t + 3)
        wv, bv, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def fit(texts: list[str], languages: list[str], *, bits: int, cells: int = 16_000_000) -> Model:
    """The machines. ``cells`` bounds the matrix of rows by features (64 MB by default), of which no copy is made."""
    names = sorted(set(languages))
    families = sorted({family(x) for x in names})
    tasks: list[tuple] = [("family", f) for f in families] if len(families) > 1 else []
    tasks += [("pair", a, b) for f in families for a, b in combinations([x for x in names if family(x) == f], 2)]
    weights, bias = np.zeros(((1 << bits) + 1, len(tasks)), np.float32), np.zeros(len(tasks))
    if tasks:
        order = np.argsort(languages, kind="stable")  # so that each language has adjacent rows
        lang = np.array(languages)[order]
        total, square = np.zeros(1 << bits), np.zeros(1 << bits)
        for i in order:
            f = frequencies(texts[i], bits)
            total += f
            square += f * f
        spread = np.sqrt(np.maximum(0, square / len(lang) - (total / len(lang)) ** 2))
        most = max(1, cells // len(lang))
        used = np.arange(1 << bits) if most >= 1 << bits else np.sort(np.argsort(-spread, kind="stable")[:most])
        scale = 1 / (spread[used] + 1e-5) / np.sqrt(len(used))
        x = np.empty((len(lang), len(used)), np.float32)
        for k, i in enumerate(order):
            x[k] = frequencies(texts[i], bits)[used] * scale
        rows = {v: slice(int(np.searchsorted(lang, v)), int(np.searchsorted(lang, v, "right"))) for v in names}
        fam = np.array([family(v) for v in lang])
        for k, task in enumerate(tasks):
            parts = [x] if task[0] == "family" else [x[rows[v]] for v in task[1:]]
            y = np.where(fam == task[1], 1.0, -1.0) if task[0] == "family" else np.repeat([1.0, -1.0], [len(p) for p in parts])
            w, bias[k] = svm(parts, y)
            weights[used, k] = w * scale
    return Model(names, families, tasks, weights, bias)


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) for each row of margins."""
    n, at = len(margins), {t: k for k, t in enumerate(model.tasks)}
    fam = np.zeros(n, int)
    sure = np.ones(n)
    if len(model.families) > 1:
        m = margins[:, : len(model.families)]
        fam = m.argmax(1)
        rest = np.sort(m, 1)
        sure = 1 / (1 + np.exp(-2 * (rest[:, -1] - rest[:, -2])))
    best = np.zeros(n, int)
    for f, name in enumerate(model.families):
        rows = np.flatnonzero(fam == f)
        own = [i for i, x in enumerate(model.languages) if family(x) == name]
        votes = np.zeros((len(rows), len(own)))
        total = np.zeros((len(rows), len(own)))
        worst = np.full((len(rows), len(own)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(own), 2):
            m = margins[rows, at["pair", model.languages[a], model.languages[b]]]
            for p, s in ((i, m), (j, -m)):
                votes[:, p] += s > 0
                total[:, p] += s
                worst[:, p] = np.minimum(worst[:, p], s)
        win = (votes + 1e-3 * np.tanh(total)).argmax(1)
        best[rows] = np.array(own)[win]
        if len(own) > 1:
            sure[rows] *= 1 / (1 + np.exp(-2 * worst[np.arange(len(rows)), win]))
    return best, np.clip(np.round(sure, 6), 0, 1)


def sample(docs: DataFrame, allowed: Column, *, text_col: str, lang_col: str, per_language: int, sample_rows: int, sample_chars: int, most_languages: int) -> tuple[list[str], list[str]]:
    """(texts, languages). Distinct texts are counted first, so that each language sends about twice what it may keep, however large it is, and copies count once."""
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("texts"), "lang").limit(most_languages).collect()
    if not sizes:
        return [], []
    each = max(1, min(per_language, sample_rows // len(sizes)))
    stretch = max(1, sample_chars // (each * len(sizes)))
    rate = F.lit(None).cast("double")
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], (2.0 * each + 50.0) / max(1, r["texts"])).otherwise(rate)
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))
    start = F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - stretch + 1, F.lit(1))) + 1
    rows = rows.select("lang", "h", F.col("text").substr(start.cast("int"), F.lit(stretch)).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    picked = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= each)
    got = sorted((r.lang, r.text) for r in picked.select("lang", "text").collect())
    return [t for _, t in got], [x for x, _ in got]


def train(docs: DataFrame, allowed: Column, *, text_col="text", lang_col="lang", per_language=800, sample_rows=4000, sample_chars=8_000_000, most_languages=200, bits=13) -> Model:
    """A model from the rows where ``allowed`` holds and the language is known."""
    return fit(*sample(docs, allowed, text_col=text_col, lang_col=lang_col, per_language=per_language, sample_rows=sample_rows, sample_chars=sample_chars, most_languages=most_languages), bits=bits)


def predict(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", bits=13, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``keep`` columns, lang_pred and score. A column to keep that has the name of a result gives way to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in dict.fromkeys([id_col, *keep]) if c not in (text_col, "lang_pred", "score")]
    with_text = text_col in keep

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in textops.sliced(batches, "text"):
            col = batch["text"].cast(pa.large_string())
            g, off = grams(col, bits)
            n = batch.num_rows
            full = np.flatnonzero(np.diff(off))
            margins = np.zeros((n, len(model.tasks)))
            if len(full):
                count = np.maximum(1, np.add.reduceat((g < 1 << bits).astype(np.int64), off[full]))
                for k in range(len(model.tasks)):
                    margins[full, k] = np.add.reduceat(model.weights[:, k][g], off[full], dtype=np.float64) / count
            best, sure = decide(model, margins + model.bias)
            letters = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False) & bool(model.languages)
            out = [batch[f"k{i}"] for i in range(len(kept))] + ([batch["text"]] if with_text else [])
            out += [pa.array(names[np.where(letters, best, len(names) - 1)].tolist(), pa.string()), pa.array(np.where(letters, sure, 0.0))]
            yield pa.RecordBatch.from_arrays(out, [*(f"k{i}" for i in range(len(kept))), *(["text"] if with_text else []), "lang_pred", "score"])

    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + (["text string"] if with_text else []) + ["lang_pred string", "score double"]
    base = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)), F.col(text_col).alias("text"))
    found = textops.in_small_batches(base).mapInArrow(run, ", ".join(kinds))
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), *([F.col("text").alias(text_col)] if with_text else []), "lang_pred", "score")
