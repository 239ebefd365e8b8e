"""Best-fit packing of tokenised documents into fixed-length training sequences.

Token ids are those of a ``tokenizers`` file (byte-level BPE). Its vocabulary is also published as a rank file, which
``tiktoken`` reads and encodes several times faster; the ids are equal (a test compares them). Texts with a run of ``LONG_SPACE`` or more bytes that may be white
space, which tiktoken's pattern can't match, go through ``tokenizers`` itself. A text longer than one sequence is cut into full pieces, of which
the first may be shorter.

Pieces are dealt at random to packers of about ``pieces_per_packer`` pieces, and each packer is a bounded-space online best-fit: it takes its pieces in
the order of a hash, whatever their length; it has at most ``open_bins`` open bins, however many pieces there are, in a bitset keyed by free
space; a piece goes to the open bin it fills best, and when no bin has room and all are open, the fullest closes. What a packer holds is its open bins.

Null and empty texts have the end token alone. Repeated rows are packed as often as they occur. An empty
table gives an empty result. Columns other than the id and the text are ignored. Ties: of open bins with equal space, that which was opened or changed last.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import textops

GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = 10_000
PIECES = "id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def rank_encoder(rank_file: str) -> tiktoken.Encoding:
    """The encoder of a file with one base64 token and its id a line; the next free id is <|endoftext|>."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def beside(rank_file: str) -> str:
    """The ``tokenizers`` file that lies beside the rank file of the same vocabulary."""
    return rank_file.removesuffix(".tiktoken") + ".json"


class Encoder:
    """Token ids of texts by a ``tokenizers`` file, or by the rank file of the same vocabulary where that can encode them."""

    def __init__(self, tokenizer_file: str, rank_file: str):
        self.file, self.ranks, self.whole = tokenizer_file, rank_encoder(rank_file), None
        # all bytes of white-space characters in UTF-8: some others as well, so a run of them may hold no white space
        self.space = np.zeros(256, bool)
        self.space[list({b for c in range(0x3001) if chr(c).isspace() for b in chr(c).encode()})] = True

    def long_space(self, text: str) -> bool:
        if len(text) * 3 < LONG_SPACE:
            return False
        other = np.flatnonzero(~self.space[np.frombuffer(text.encode(), np.uint8)])
        ends = np.concatenate([[-1], other, [len(text.encode())]])
        return int(np.diff(ends).max()) > LONG_SPACE

    def ids(self, text: str) -> np.ndarray:
        if not self.long_space(text):
            return self.ranks.encode_to_numpy(text, allowed_special="all")
        self.whole = self.whole or Tokenizer.from_file(self.file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; all but the first are full."""
    first = n % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def token_pieces(docs: DataFrame, rank_file: str, *, tokenizer_file: str | None = None, id_col="doc_id", text_col="text", capacity=1024, end_id=2, keep_ids=False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and its token ids with ``keep_ids``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = Encoder(tokenizer_file or beside(rank_file), rank_file)
        for batch in textops.sliced(batches, "text"):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
                    if keep_ids:
                        kept.append(ids[a : a + n].astype(np.int32))
            out = [batch["id"].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = PIECES.format(id=kind) + (", ids array<int>" if keep_ids else "")
    return textops.in_small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


class OpenBins:
    """At most ``most`` open bins; bit f of ``free`` is set when some open bin has f places left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.free, self.count, self.bins, self.made = capacity, most, 0, 0, {}, 0

    def _put(self, free: int, number: int) -> None:
        self.bins.setdefault(free, []).append(number)
        self.free |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(bin number, offset) for a piece of ``size``."""
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.most and size < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        if free > size:
            self._put(free - size, number)
        return number, self.capacity - free


def place_pieces(pieces: DataFrame, *, capacity=1024, open_bins=256, pieces_per_packer=65_536, total: int | None = None, deal: Column | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of at most ``capacity``.

    Packers get equal random shares by a hash of all columns (or ``deal``), and take them in the order of that hash, so a lost task gives the same bins again.
    """
    total = pieces.count() if total is None else total
    packers = max(1, math.ceil(total / pieces_per_packer))
    plain = [f.name for f in pieces.schema if f.dataType.typeName() != "array"]
    key = F.xxhash64(*plain) if deal is None else deal
    dealt = pieces.withColumn("_key", key).repartition(packers, "_key").sortWithinPartitions("_key", *plain)
    dealt = dealt.withColumn("_packer", F.spark_partition_id().cast("bigint"))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def run(batches):
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            base = batch["_packer"].to_numpy() << 33
            at = [bins.place(n) for n in batch["length"].to_pylist()]
            number, offset = np.array(at, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(base + number), pa.array(np.ascontiguousarray(offset))], [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)


def pack(docs: DataFrame, rank_file: str, *, tokenizer_file: str | None = None, id_col="doc_id", text_col="text", capacity=1024, end_id=2, open_bins=256, pieces_per_packer=65_536, keep_ids=False) -> DataFrame:
    """All documents as placed pieces. The ``tokenizers`` file is that beside the rank file, if none is named. Pieces are checkpointed, so texts are tokenised once."""
    pieces = textops.checkpointed(token_pieces(docs, rank_file, tokenizer_file=tokenizer_file, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids))
    placed = place_pieces(pieces, capacity=capacity, open_bins=open_bins, pieces_per_packer=pieces_per_packer)
    return placed.withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences (sequence_id, ids) of pieces placed with ``keep_ids``; one has ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
