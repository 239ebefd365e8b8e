"""Token counts by linear longest-match: how many word pieces greedy longest-match-first gives, without building the pieces.

The vocabulary becomes a trie with two roots: the start of a word, and the continuation of one. Every node has a failure link and the
number of pieces that are popped on taking it, both precomputed breadth first. A word is read byte by byte; where no edge
fits, the node's popped pieces are counted and its failure link is taken, so each byte is read once.

All distinct words of a batch run through the automaton together, one numpy lane a word, while at least ``FEW_LANES`` are left; the rest of the longest words is
walked byte by byte, so a very long word costs time in proportion to its bytes. The vocabulary comes from a byte-level BPE file: tokens that begin with its
space mark start words, others continue them, and all single bytes do both, so any word can be cut. Words are runs of
bytes other than white space (0x20, 0x09 to 0x0D). Tables go to executors in one broadcast; their size is bounded by the vocabulary's.

Null and empty texts count 0. Ties: none, as a longest match is unique. Repeated rows get equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import textops

START, REST = 0, 1
#: A step of one lane alone costs about as much as this many steps of the plain walk.
FEW_LANES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 characters stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return out


def vocabulary(file: str) -> tuple[set[bytes], set[bytes]]:
    """(word starts, continuations) of a ``tokenizers`` file with a byte-level BPE model."""
    with open(file, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    starts, rest = {bytes([b]) for b in range(256)}, {bytes([b]) for b in range(256)}
    for t in tokens:
        if all(c in alphabet for c in t):
            raw = bytes(alphabet[c] for c in t)
            if raw.startswith(b" ") and len(raw) > 1:
                starts.add(raw[1:])
            elif raw:
                rest.add(raw)
    return starts, rest


@dataclass
class Automaton:
    keys: np.ndarray  # node * 256 + byte of each edge, sorted
    nodes: np.ndarray  # where the edge leads
    fail: np.ndarray
    pops: np.ndarray
    plain: tuple | None = None  # the same tables for the plain walk, made in a task that needs them

    def walk(self, node: int, data: bytes) -> tuple[int, int]:
        """(node, pieces popped) after reading ``data`` from a node on."""
        if self.plain is None:
            self.plain = dict(zip(self.keys.tolist(), self.nodes.tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()
        (edges, fail, pops), total = self.plain, 0
        for b in data:
            while (to := edges.get(node << 8 | b)) is None:
                total += pops[node]
                node = fail[node]
            node = to
        return node, total

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node, or -1."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def lengths(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each byte span."""
        count = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the lanes still running are a prefix
        a, size = starts[order], (ends - starts)[order]
        node = np.full(len(order), START, np.int64)
        total = np.zeros(len(order), np.int64)
        live = len(order)
        for k in range(int(size[0]) if live else 0):
            live = int(np.searchsorted(-size[:live], -k, side="left"))
            if live < FEW_LANES:
                for i in range(live):
                    node[i], more = self.walk(int(node[i]), buf[a[i] + k : a[i] + size[i]].tobytes())
                    total[i] += more
                break
            byte = buf[a[:live] + k].astype(np.int64)
            here = node[:live]
            to = self.step(here, byte)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                at = here[stuck]
                total[stuck] += self.pops[at]
                here[stuck] = self.fail[at]
                to[stuck] = self.step(here[stuck], byte[stuck])
                stuck = stuck[to[stuck] < 0]
            node[:live] = to
        while len(open_ := np.flatnonzero(node > REST)):
            at = node[open_]
            total[open_] += self.pops[at]
            node[open_] = self.fail[at]
        count[order] = total
        return count


def build(starts: set[bytes], rest: set[bytes]) -> Automaton:
    edges: dict[int, int] = {}
    token, parent, byte = [False, False], [-1, -1], [0, 0]
    for root, words in ((START, starts), (REST, rest)):
        for w in sorted(words):
            node = root
            for b in w:
                key = node * 256 + b
                if key not in edges:
                    edges[key] = len(token)
                    token.append(False)
                    parent.append(node)
                    byte.append(b)
                node = edges[key]
            token[node] = True
    n = len(token)
    depth = np.zeros(n, np.int64)
    for v in range(2, n):  # a parent comes before its children
        depth[v] = depth[parent[v]] + 1
    fail, pops = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for v in np.argsort(depth, kind="stable").tolist():
        if v <= REST:
            continue
        if token[v]:
            fail[v], pops[v] = REST, 1
            continue
        u = parent[v]
        z, k = int(fail[u]), int(pops[u])
        while z >= 0 and z * 256 + byte[v] not in edges:
            k += int(pops[z])
            z = int(fail[z])
        fail[v], pops[v] = edges.get(z * 256 + byte[v], -1) if z >= 0 else -1, k
    keys = np.fromiter(edges, np.int64, len(edges))
    order = np.argsort(keys)
    return Automaton(keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order], fail, pops)


def counts(docs: DataFrame, vocab_file: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, n_words, n_tokens, longest (pieces of its most divided word)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(build(*vocabulary(vocab_file)))

    def run(batches):
        automaton = shared.value
        for batch in textops.sliced(batches, "text"):
            buf, off = textops.string_buffer(batch["text"])
            starts, ends, first = textops.word_spans(buf, off, textops.space_words())
            h = textops.word_hashes(buf, starts, ends)
            _, one, back = np.unique(h, return_index=True, return_inverse=True)
            pieces = automaton.lengths(buf, starts[one], ends[one])[back]
            n, words = batch.num_rows, np.diff(first)
            doc = np.repeat(np.arange(n), words)
            longest = np.zeros(n, np.int64)
            np.maximum.at(longest, doc, pieces)
            tokens = np.bincount(doc, pieces, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(words), pa.array(tokens), pa.array(longest)], ["id", "n_words", "n_tokens", "longest"])

    return textops.in_small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint, longest bigint").withColumnRenamed("id", id_col)
