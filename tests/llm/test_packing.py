import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library(tokenizer):
    enc = packing.rank_encoder(RANKS)
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}2  {chr(c)}." for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    r = random.Random(1)
    bits = ["a", "Z", "é", " ", "  ", "\n", "\t", "1", "'s", "'S", "<|endoftext|>", "<|end", "　", "語", "👍", "!!", "\r\n", "\x00", "́", "\x85"]
    texts += ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(5000)]
    for a in range(0, len(texts), 20_000):
        part = texts[a : a + 20_000]
        for text, x in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert x.ids == enc.encode(text, allowed_special="all"), repr(text)


def documents():
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["the", "quick", "brün", "語", "123", "\n"], k=r.choice([1, 5, 60, 300, 1500, 4000])))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "<|endoftext|>"), (203, "same"), (203, "same"), (None, "x")]


def check_layout(rows, capacity):
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


def bounded_best_fit(sizes, capacity, most):
    """(bin, offset) of each piece, and how many bins closed, by a plain list of (bin, free space) of open bins, the last changed at its end."""
    opened, number, closed, out = [], 0, 0, []
    for n in sizes:
        fits = [f for _, f in opened if f >= n]
        if fits:
            at = max(i for i, b in enumerate(opened) if b[1] == min(fits))
        else:
            if len(opened) == most and n < capacity:
                fullest = min(f for _, f in opened)
                closed += 1
                del opened[max(i for i, b in enumerate(opened) if b[1] == fullest)]
            opened.append((number, capacity))
            number, at = number + 1, -1
        b, free = opened.pop(at)
        out.append((b, capacity - free))
        if free > n:
            opened.append((b, free - n))
    return out, closed


@pytest.mark.parametrize("how", [{}, {"pieces_per_packer": 60, "open_bins": 4}])
def test_whole_round_trip(spark, tokenizer, how):
    rows = documents()
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id bigint, text string, length string")
    out = packing.pack(df, RANKS, keep_ids=True, **how).collect()
    used = check_layout(out, 1024)
    texts = {}
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        texts.setdefault(r.doc_id, []).append((r.piece, r.start, list(r.ids)))
    assert len(texts) == len(set(i for i, _ in rows))
    for i, text in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(texts[i])
        assert sum((p[2] for p in pieces), []) == want * (2 if i == 203 else 1)
        if i != 203:
            assert [p[0] for p in pieces] == list(range(len(pieces))) and [p[1] for p in pieces] == [sum(len(x[2]) for x in pieces[:k]) for k in range(len(pieces))]
            assert len(pieces) == 1 or all(len(p[2]) == 1024 for p in pieces[1:])
    least = -(-sum(r.length for r in out) // 1024)
    assert used <= 1.3 * least + 2


def test_sequences(spark):
    df = spark.createDataFrame(documents(), "doc_id bigint, text string")
    placed = packing.pack(df, RANKS, keep_ids=True)
    made = {r.sequence_id: list(r.ids) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert made[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)
    assert all(0 < len(x) <= 1024 for x in made.values())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), RANKS).collect() == []


def test_open_bins_equal_a_plain_version():
    r = random.Random(9)
    bins, plain, number = packing.OpenBins(100, 5), [], 0
    for _ in range(3000):
        size = r.choice([1, 3, 10, 35, 50, 80, 99, 100])
        place = bins.place(size)
        fits = [b for b in plain if b[1] >= size]
        if fits:
            best = min(b[1] for b in fits)
            b = [b for b in fits if b[1] == best][-1]  # of equal ones the last opened or changed
            plain.remove(b)
        else:
            if len(plain) == 5 and size < 100:
                least = min(b[1] for b in plain)
                plain.remove([b for b in plain if b[1] == least][-1])  # the fullest closes
            b, number = [number, 100], number + 1
        assert place == (b[0], 100 - b[1])
        if b[1] > size:
            plain.append([b[0], b[1] - size])
        assert bins.count == len(plain) <= 5


def test_placing_equals_a_plain_version_with_production_parameters(spark):
    """One packer: pieces in the order of their deal, at most 256 open bins, the fullest of which closes."""
    r = random.Random(4)
    sizes = [min(1024, int(r.lognormvariate(5, 1.3)) + 1) for _ in range(4000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id bigint, length bigint")
    rows = {x.id: (x.sequence_id, x.offset) for x in packing.place_pieces(df, deal=F.col("id")).collect()}
    want, closed = bounded_best_fit(sizes, 1024, 256)
    assert [rows[i] for i in range(4000)] == want
    assert closed > 100


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000, "a" + " " * 1_000_000 + "b", "x " * 5000 + "\u3000\u00a0" * 200_000 + "y", "語" * 20_000 + "\t" * 12_000])
def test_long_white_space_equals_tokenizers(spark, tokenizer, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = sum((list(r.ids) for r in sorted(packing.pack(df, RANKS, keep_ids=True).collect(), key=lambda r: r.piece)), [])
    assert got == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
