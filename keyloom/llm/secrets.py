"""Secret scans: three fixed patterns, and strings that a compressor primed with identifiers and their surroundings can't shorten.

Base spans come from the patterns ``assign``, ``access`` and ``hex``. The method adds ``novel`` spans: a candidate is a run of ``MIN_CANDIDATE`` or
more token characters with a letter and a digit, at most ``REACH`` characters after a word such as "key" or "auth" on its line, that
touches no base span. A run that isn't reported as a whole is also cut after each "=" with more characters behind it, so that the value of an assignment
without spaces is a candidate and its name a context.

Novelty is the number of bytes that a candidate adds to a zstandard frame which holds the text around it, with a dictionary of words from the corpus and of
names and dates that code often has. Every character is written as four bytes there, so that any phrase of the dictionary or the surroundings, however
short, costs less than its characters: the bytes then follow the number of phrases. The same is measured for ``SHUFFLES`` shuffles of the candidate's
characters, so length and alphabet cancel out. A random key needs as many bytes as its shuffles; words, paths, dates and what occurs
nearby need fewer. Candidates with ``ratio`` or more of the shuffles' mean are reported, less ``MARGIN / sqrt(length)`` for the
chance that a short random key meets phrases of the dictionary. Copies of the candidate that also follow a sensitive word, or lie in a base span, don't count
as surroundings; copies elsewhere do.

``train`` counts the words of all texts, whole, and gives the commonest ones for the dictionary; without training it is the fixed one.

Spans are in code points, end exclusive. Every text is scanned whole, in place; Arrow's linear-time matcher first tells
which texts can have a match at all. A very long text takes memory in proportion to itself. Null texts are empty and have no spans. Repeated rows get equal results. An empty
table gives an empty result. Other columns are ignored or, with ``keep``, passed on.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import textops

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
CONTEXT = r"(key|auth|bearer|credential|private|pwd|passphrase|secret|token|cookie|session|signature|salt)"
MIN_CANDIDATE = 20
AROUND = 1024
REACH = 40
SHUFFLES = 8
MARGIN = 0.9
# Words that a task counts before it passes them on, and characters of a text whose words aren't listed before they are counted.
MOST_HELD, LONG = 200_000, 1_000_000
# Words that names in code often hold.
IDENTIFIERS = """
account address admin alert api array authorization average backup balance bearer bucket buffer build builder cache callback candidate certificate class client
cluster code collection column config connection container context controller create credential currency current customer data database date debug default
delete deployment description device document download email encryption endpoint environment error event exception export feature field file filter final format
function global group handler hash header host identifier image import index input instance invoice job key kubernetes language latest library link list log
login manager manifest master message metadata metric model module name namespace network node notification object online order package partition password path
payment permission pipeline policy pool primary private process processor product production profile protocol provider public queue region registry release
replica report repository request resource response result role route sample schedule schema secondary secret security server service session share size source
start status storage store summary table target template temporary test timeout timestamp token update upload user username validator value variable version
view volume warehouse worker workflow
""".split()
# four bytes for each character, from a rule: no two of them share a sequence of bytes that a match could use
CODES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype("<u4")


class Novelty:
    """Measures candidates with a dictionary of ``words``, IDENTIFIERS and the months of 1990 to 2039."""

    def __init__(self, words: tuple[str, ...] = ()):
        months = (f"{y}-{m:02d}-" for y in range(1990, 2040) for m in range(1, 13))
        listed = self.coded(" ".join([*words, *months, *IDENTIFIERS])).tobytes()
        primed = zstandard.ZstdCompressionDict(listed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # a tree over the whole window finds words wherever they are listed; lazy2's tables lost those listed first, the commonest
        window = max(19, len(listed).bit_length() + 1)
        how = zstandard.ZstdCompressionParameters.from_level(9, strategy=zstandard.STRATEGY_BTLAZY2, window_log=window, hash_log=18, chain_log=window + 1, search_log=9, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
        primed.precompute_compress(compression_params=how)
        self.compressor = zstandard.ZstdCompressor(compression_params=how, dict_data=primed)

    @staticmethod
    def coded(text: str) -> np.ndarray:
        return CODES[np.frombuffer(text.lower().encode("latin-1", "replace"), np.uint8)]

    def share(self, candidate: str, around: str) -> float:
        """The candidate's marginal bytes as a share of what its shuffles need in the same place."""
        front, own = self.coded(f"{around} "), self.coded(candidate)
        rng = np.random.default_rng(zlib.crc32(own.tobytes()))

        def size(x: np.ndarray) -> int:
            return len(self.compressor.compress(np.concatenate([front, x]).tobytes()))

        empty = size(own[:0])
        shuffled = sum(size(rng.permutation(own)) - empty for _ in range(SHUFFLES)) / SHUFFLES
        return (size(own) - empty) / max(1.0, shuffled)


def words_of(text: str) -> set[str]:
    """The different words of 4 to 20 letters that touch no digit, in lower case. Letters between digits are more likely a key's."""
    runs = re.findall(r"[a-z0-9]{4,}", text) if len(text := text.lower()) <= LONG else (m.group() for m in re.finditer(r"[a-z0-9]{4,}", text))
    return {w for w in runs if len(w) <= 20 and w.isalpha()}


def train(docs: DataFrame, *, text_col="text", words=3000) -> tuple[str, ...]:
    """The commonest words (see ``words_of``) that two or more different texts have, by number of texts: every text is read whole, and copies count once.

    A text with n copies is counted n times as one of n, so that the counts of its words are divided by n and texts stay where they are; only a hash and a number
    for each text with copies, and the counts, are shuffled.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    scratch = textops.Scratch(docs.sparkSession)
    copied = scratch.save(texts.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    told = texts.join(textops.small(copied), "h", "left").select("text", F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))

    def run(batches):
        def flush():
            for n, found in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([n] * len(found), pa.int64()), pa.array(found.values(), pa.int64())], ["word", "copies", "n"])

        seen = {}
        for batch in textops.sliced(batches, "text"):
            for text, n in zip(batch["text"], batch["copies"].to_pylist(), strict=True):
                seen.setdefault(n, Counter()).update(words_of(text.as_py()))
            if sum(map(len, seen.values())) > MOST_HELD:
                yield from flush()
                seen = {}
        yield from flush()

    counts = textops.in_small_batches(told).mapInArrow(run, "word string, copies bigint, n bigint").groupBy("word", "copies").agg(F.sum("n").alias("n"))
    by_word = counts.groupBy("word").agg(F.sum(F.expr("n div copies")).alias("texts")).where("texts > 1")
    common = tuple(r.word for r in by_word.orderBy(F.desc("texts"), "word").limit(words).collect())
    scratch.drop("copied")
    return common


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches that are long enough."""
    out = []
    for m in re.finditer(ASSIGN, text, re.I | re.A):
        if m.end(2) - m.start(2) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        # a run is matched whole or not at all, so the length can be asked for in the pattern where runs are simple
        for m in re.finditer(pattern if kind == 1 else r"[0-9a-f]{24,}", text):
            if m.end() - m.start() >= least:
                out.append((m.start(), kind, m.end()))
    return out


def in_context(text: str, a: int) -> bool:
    """Whether a sensitive word ends 1 to REACH characters before, on the same line."""
    before = text[max(0, a - REACH - 20) : a].rpartition("\n")[2]
    return re.search(rf"{CONTEXT}.{{1,{REACH}}}$", before, re.I | re.A | re.S) is not None


def overlaps(a: int, b: int, taken: list[tuple[int, int, int]]) -> bool:
    return any(a < e and s < b for s, _, e in taken)


def surroundings(text: str, a: int, b: int, taken: list[tuple[int, int, int]]) -> str:
    """AROUND characters before and after the candidate, without its copies that may be secrets themselves."""
    word, n = text[a:b], b - a
    parts = []
    for lo, hi in ((max(0, a - AROUND), a), (b, b + AROUND)):
        at = lo
        # a copy that only partly lies within is taken out as well
        p = text.find(word, max(0, lo - n + 1) if hi == a else b, hi if hi == a else hi + n - 1)
        while p >= 0:
            if in_context(text, p) or overlaps(p, p + n, taken):
                parts.append(text[at : max(at, p)])
                at = p + n
            p = text.find(word, p + n, hi if hi == a else hi + n - 1)
        parts.append(text[at : max(at, hi)])
    return " ".join(parts)


def novel(text: str, a: int, b: int, taken: list[tuple[int, int, int]], ratio: float, novelty: Novelty) -> bool:
    word = text[a:b]
    if b - a < MIN_CANDIDATE or not re.search(r"[0-9]", word) or not re.search(r"[A-Za-z]", word):
        return False
    if not in_context(text, a) or overlaps(a, b, taken):
        return False
    return novelty.share(word, surroundings(text, a, b, taken)) >= ratio - MARGIN / math.sqrt(b - a)


def novel_spans(text: str, taken: list[tuple[int, int, int]], ratio: float, novelty: Novelty | None = None) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}", text):
        novelty = novelty or Novelty()
        a, b = m.span()
        if novel(text, a, b, taken, ratio, novelty):
            out.append((a, 3, b))
        elif "=" in m.group():
            parts = (p.span() for p in re.finditer(r"[^=]+(?:=+$)?", m.group()))
            out += [(a + s, 3, a + e) for s, e in parts if novel(text, a + s, a + e, taken, ratio, novelty)]
    return out


def find(text: str, base: bool, context: bool, ratio: float, novelty: Novelty | None = None) -> list[tuple[int, int, int]]:
    spans = base_spans(text) if base else []
    return sorted(spans + (novel_spans(text, spans, ratio, novelty) if context else []))


def possible(col) -> tuple[list[bool], list[bool]]:
    """Which texts can have a base match, and which a candidate; linear-time tests that may say yes too often."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    base = pc.match_substring_regex(col, rf"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=])|AKIA[A-Z0-9]|[0-9a-f]{{24}}")
    context = pc.match_substring_regex(col, rf"(?i:{CONTEXT})[^\n]+[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE}}}")
    return base.to_pylist(), context.to_pylist()


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans, mark: str) -> str:
    """The text with every stretch of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", ratio=0.9, words: tuple[str, ...] = (), keep: tuple[str, ...] = (), mark: str | None = None) -> DataFrame:
    """Per row: id, ``keep`` columns, n_assign, n_access, n_hex, n_novel, base_sha256, spans and, if ``mark`` is given, redacted. ``words`` come from ``train``. A column to keep that has the name of a result gives way to it."""
    results = {*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"}
    kept = [c for c in dict.fromkeys([id_col, *keep]) if c != text_col and c not in results]

    def run(batches):
        novelty = Novelty(words)
        for batch in textops.sliced(batches, "text"):
            base, context = possible(batch["text"])
            counts, digest, spans, clean = [], [], [], []
            for i, (x, y) in enumerate(zip(base, context, strict=True)):
                found = []
                if x or y or mark is not None:
                    text = batch["text"][i].as_py()
                    if x or y:
                        found = find(text or "", x, y, ratio, novelty)
                    if mark is not None:
                        clean.append(redacted(text, found, mark) if found else text)
                counts.append([sum(k == kind for _, k, _ in found) for kind in range(4)])
                digest.append(hashlib.sha256(joined(s for s in found if s[1] < 3).encode()).hexdigest())
                spans.append(joined(found))
            out = [batch[f"k{i}"] for i in range(len(kept))] + [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)] + [pa.array(digest), pa.array(spans)]
            names = [*(f"k{i}" for i in range(len(kept))), *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if mark is not None:
                out.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(out, names)

    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"n_{k} bigint" for k in KINDS] + ["base_sha256 string", "spans string"] + (["redacted string"] if mark is not None else [])
    base = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)), F.col(text_col).alias("text"))
    found = textops.in_small_batches(base).mapInArrow(run, ", ".join(kinds))
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(["redacted"] if mark is not None else []))
