"""Benchmark decontamination: Wu-Manber search of documents for all word windows of test items.

Texts and items become sequences of words and their 64-bit hashes. Patterns are the windows of ``window`` consecutive item words; an
item of fewer words is one window. Patterns of one length form a Wu-Manber automaton over words: a block is the last
three words (fewer in shorter patterns) before a position; the shift table tells from the block's hash how far no
pattern can end; at shift 0 the block's hash selects a bucket of test windows. A window whose words have the document's hashes is then compared byte
for byte. A batch is scanned in many lanes at once, each a stretch of 256 positions.

Items come in blocks of at most ``block_words`` words (one item at least), and tables of one block exist at a time: the driver makes and broadcasts them, some 60
bytes a word. With one block every text is searched whole, in place, without a shuffle. With more, there is one pass over the
documents for each block, which keeps only what it found; the findings are merged by text and joined to the documents. Very long texts are cut into lanes
like any other and need memory in proportion to one text.

Null, empty and wordless texts have no words and are never contaminated. Items without an id or without words are
ignored; items with equal windows are all found. Repeated rows give repeated results. Without documents the result is empty, without items nothing is
hit. Other columns of documents are ignored or, with ``keep``, passed on.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import textops

LANE = 256
RESULT = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean", "spans": "array<struct<start:bigint,end:bigint>>", "items": "array<string>"}
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Findings of several blocks up to this size are broadcast to the documents; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


class Words:
    """The words of a string column: lower-cased bytes, byte spans, hashes, and the first word of each text."""

    def __init__(self, col):
        buf, off = textops.string_buffer(col)
        self.buf = textops.lower_table()[buf]
        starts, ends, self.first = textops.word_spans(self.buf, off, textops.alnum_words())
        self.hashes = textops.word_hashes(self.buf, starts, ends)
        small = np.int32 if len(self.buf) < 2**31 else np.int64
        self.starts, self.ends = starts.astype(small), ends.astype(small)


def block_hash(h: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words up to and including position ``end``."""
    out = np.zeros(len(end), np.uint64)
    for k in range(size):
        out = out * textops.M1 + h[end - k]
        out ^= out >> np.uint64(31)
    return out * textops.M2 >> np.uint64(20)


class Patterns:
    """The Wu-Manber tables of patterns of m words each, which are stretches of the items' words from ``where`` on."""

    def __init__(self, h: np.ndarray, m: int, where: np.ndarray, owner_at: np.ndarray, owner: np.ndarray):
        self.m = m
        self.block = min(3, m)
        most = m - self.block + 1
        self.mask = np.uint64((1 << min(26, max(10, int(len(where) * 8).bit_length()))) - 1)
        self.shift = np.full(int(self.mask) + 1, most, np.uint8)
        for end in range(self.block - 1, m):  # the last block, with shift 0, comes last and is the least
            slot = block_hash(h, where + end, self.block) & self.mask
            self.shift[slot] = np.minimum(self.shift[slot], m - 1 - end)
        suffix = block_hash(h, where + (m - 1), self.block)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.where = suffix[order], where[order]
        size = np.diff(owner_at)[order]
        self.owner_at = np.concatenate([[0], np.cumsum(size)])
        self.owner = owner[np.repeat(owner_at[:-1][order] - self.owner_at[:-1], size) + np.arange(len(owner))]

    def find(self, h: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end positions, pattern rows) where one sequence of word hashes has a pattern's; ``items``: the hashes of the items' words."""
        n = len(h)
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.arange(self.m - 1, n, LANE)
        stop = np.minimum(pos + LANE, n)
        ends, rows = [], []
        while len(pos):
            block = block_hash(h, pos, self.block)
            step = self.shift[block & self.mask].astype(np.int64)
            if len(test := np.flatnonzero(step == 0)):
                at, key = pos[test], block[test]
                lo, hi = np.searchsorted(self.suffix, key), np.searchsorted(self.suffix, key, side="right")
                while len(live := np.flatnonzero(lo < hi)):  # the k-th test window of every bucket
                    at, lo, hi = at[live], lo[live], hi[live]
                    same = np.ones(len(at), bool)
                    for k in range(self.m):
                        if not same.any():
                            break
                        same &= h[at - self.m + 1 + k] == items[self.where[lo] + k]
                    ends.append(at[same])
                    rows.append(lo[same])
                    lo = lo + 1
                step[test] = 1
            pos = pos + step
            live = pos < stop
            pos, stop = pos[live], stop[live]
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(ends + empty), np.concatenate(rows + empty)


class Table:
    """A block of items and the patterns of each length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [i for i, _ in items]
        self.words = w = Words(pa.array([t for _, t in items], pa.large_string()))
        n_words = np.diff(w.first)
        self.groups = []
        for m in sorted({min(window, int(n)) for n in n_words if n}):
            mine = np.flatnonzero(n_words >= window if m == window else n_words == m)
            count = n_words[mine] - m + 1
            where = np.repeat(w.first[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            key = textops.gram_hashes(w.hashes, m)[where]
            order = np.argsort(key, kind="stable")
            where, owner, key = where[order], np.repeat(mine, count)[order], key[order]
            new = np.ones(len(where), bool)  # whether a window differs from the one before it
            twin = np.flatnonzero(key[1:] == key[:-1])
            equal = np.ones(len(twin), bool)
            for k in range(m):
                equal &= self.same(w, where[twin] + k, where[twin + 1] + k)
            new[twin[equal] + 1] = False
            pattern = np.cumsum(new) - 1
            once = np.ones(len(where), bool)  # an item owns a window once
            once[1:] = new[1:] | (owner[1:] != owner[:-1])
            owner_at = np.concatenate([[0], np.cumsum(np.bincount(pattern[once]))])
            self.groups.append(Patterns(w.hashes, m, where[new], owner_at, owner[once].astype(np.int32)))

    def same(self, docs: Words, doc_word: np.ndarray, item_word: np.ndarray) -> np.ndarray:
        """Whether the bytes of a word of ``docs`` are those of a word of the items."""
        w = self.words
        return textops.same_spans(docs.buf, docs.starts[doc_word], docs.ends[doc_word], w.buf, w.starts[item_word], w.ends[item_word])

    def occurrences(self, docs: Words, doc: np.ndarray):
        """(pattern group, first word, row) of all occurrences; ``doc`` has the text of each word."""
        for p in self.groups:
            end, row = p.find(docs.hashes, self.words.hashes)
            start = end - p.m + 1
            inside = doc[start] == doc[end] if len(end) else np.zeros(0, bool)
            start, row = start[inside], row[inside]
            if len(start):  # neighbouring windows share words, so each pair of words is compared once
                both = np.stack([start, p.where[row]], 1)[:, :, None] + np.arange(p.m)
                code, back = np.unique(both[:, 0] * len(self.words.starts) + both[:, 1], return_inverse=True)
                same = self.same(docs, *np.divmod(code, len(self.words.starts)))[back.reshape(-1, p.m)].all(1)
                start, row = start[same], row[same]
            yield p, start, row


def hits(docs: Words, table: Table) -> tuple[np.ndarray, list[set[str]]]:
    """(whether each word is hit, the items of each text)."""
    n = len(docs.first) - 1
    doc = np.repeat(np.arange(n), np.diff(docs.first))
    cover = np.zeros(len(doc) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(n)]
    for p, start, row in table.occurrences(docs, doc):
        np.add.at(cover, start, 1)
        np.add.at(cover, start + p.m, -1)
        pairs = np.unique(np.stack([doc[start], row], 1), axis=0)
        for d, r in pairs.tolist():
            found[d].update(table.names[k] for k in p.owner[p.owner_at[r] : p.owner_at[r + 1]])
    return np.cumsum(cover)[:-1] > 0, found


def runs(hit: np.ndarray) -> list[dict[str, int]]:
    """The spans of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def result_arrays(docs: Words, hit: np.ndarray, found: list[set[str]], share: int) -> list[pa.Array]:
    """The columns of RESULT."""
    n, words = len(found), np.diff(docs.first)
    n_hit = np.bincount(np.repeat(np.arange(n), words)[hit], minlength=n)
    spans = [runs(hit[a:b]) if k else [] for a, b, k in zip(docs.first[:-1], docs.first[1:], n_hit, strict=True)]
    items = [sorted(x) for x in found]
    return [pa.array(words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array((n_hit > 0) & (share * n_hit >= words)), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """The number of blocks, and one list of (id, text) at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return blocks, ([(r.id, r.text) for r in items.where(part == k).orderBy("id", "text").collect()] for k in range(blocks))


def found_in_blocks(base: DataFrame, blocks, window: int) -> DataFrame:
    """(h1, h2, spans, items) of each text, known by two hashes, with a hit in any block; one pass over ``base`` for each block."""
    spark = base.sparkSession
    scratch = textops.Scratch(spark)
    keyed = textops.in_small_batches(base.where("text is not null").select(F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text"))
    schema, names = f"h1 bigint, h2 bigint, spans {RESULT['spans']}, items {RESULT['items']}", ["h1", "h2", "spans", "items"]
    found = None
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(Table(block, window))

        def run(batches, shared=shared):
            for batch in textops.sliced(batches, "text"):
                docs = Words(batch["text"])
                hit, items = hits(docs, shared.value)
                some = [d for d, x in enumerate(items) if x]
                spans = pa.array([runs(hit[docs.first[d] : docs.first[d + 1]]) for d in some], SPANS)
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(some, pa.int64())) for c in ("h1", "h2")), spans, pa.array([sorted(items[d]) for d in some], pa.list_(pa.string()))], names)

        one = scratch.save(keyed.mapInArrow(run, schema).groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("spans", "items"))), f"block{k}")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    # one row of each block at most meets here
    return found.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window=13, block_words=500_000, share=20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: id, ``keep`` columns, n_words, n_hit, n_items, items_sha256, contaminated, spans of hit words, items.

    A document is contaminated when ``share`` times its hit words reach its words. A column to keep that has the name of a result gives way to it.
    """
    kept = [c for c in dict.fromkeys([id_col, *keep]) if c != text_col and c not in RESULT]
    base = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)), F.col(text_col).alias("text"))
    blocks, each = item_blocks(benchmark, item_col, item_text, block_words)
    passed = [*(f"k{i}" for i in range(len(kept))), *(["text"] if text_col in keep else [])]
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(Table(next(each), window))

        def run(batches):
            for batch in textops.sliced(batches, "text"):
                words = Words(batch["text"])
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), *result_arrays(words, *hits(words, shared.value), share)], [*passed, *RESULT])

    else:
        found = textops.Scratch(docs.sparkSession).save(found_in_blocks(base, each, window), "found")
        size = found.agg(F.sum(64 + 24 * F.size("spans") + 24 * F.size("items"))).first()[0] or 0
        keys = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
        base = base.withColumn("h1", keys[0]).withColumn("h2", keys[1]).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["h1", "h2"], "left").drop("h1", "h2")

        def run(batches):
            for batch in textops.sliced(batches, "text"):
                words = Words(batch["text"])
                hit, items = np.zeros(len(words.starts), bool), [set() for _ in range(batch.num_rows)]
                for d in np.flatnonzero(batch["spans"].is_valid()):
                    items[d].update(batch["items"][d].as_py())
                    for s in batch["spans"][d].as_py():
                        hit[words.first[d] + s["start"] : words.first[d] + s["end"]] = True
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), *result_arrays(words, hit, items, share)], [*passed, *RESULT])

    kinds = [f"{c} {base.schema[c].dataType.simpleString()}" for c in passed]
    found = textops.in_small_batches(base).mapInArrow(run, ", ".join(kinds + [f"{k} {v}" for k, v in RESULT.items()]))
    names = [*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), *([F.col("text").alias(text_col)] if text_col in keep else [])]
    return found.select(*names, *RESULT)
