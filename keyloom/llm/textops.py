"""Vectorised helpers over Arrow string columns: word boundaries, word hashes and n-gram hashes.

All of them work on the UTF-8 buffer of a whole record batch at once, so a task spends a few
numpy passes per batch rather than Python work per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
SEED = np.uint64(0x9E3779B97F4A7C15)


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and keeps every other byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_words() -> np.ndarray:
    """Word bytes for ``[^\\x20\\x09-\\x0D]+``: everything but six white-space bytes."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_words() -> np.ndarray:
    """Word bytes for ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: digits, a-z and all of non-ASCII."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def string_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes. The bytes start at offset 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, first): byte spans of words, and for each text the index of its first word.

    A word never crosses from one text into the next; ``first`` has one entry more than texts.
    """
    if len(buf) == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    w = is_word[buf]
    before = np.empty(len(w) + 1, bool)
    before[0] = False
    before[1:] = w
    inner = offsets[:-1]
    after = np.empty(len(w) + 1, bool)
    after[:-1] = w
    after[-1] = False
    before[inner[inner < len(w)]] = False
    after[offsets] = False
    starts = np.flatnonzero(w & ~before[:-1])
    ends = np.flatnonzero(w & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """The little-endian number of the eight bytes from every position on; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(buf) + 1,), strides=(1,))


def low_bytes(left: np.ndarray) -> np.ndarray:
    """A mask of the first ``left`` bytes, of eight at most."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, eight bytes at a time."""
    words, length = eight_bytes(buf), ends - starts

    def chunk(at, left):
        return words[at] & low_bytes(left)

    h = mix(chunk(starts, length) ^ (length.astype(np.uint64) * SEED))
    live = np.flatnonzero(length > 8)
    at, left = starts[live] + 8, length[live] - 8
    while len(live):
        h[live] = mix(h[live] * M2 + chunk(at, left))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of ``a`` equal those of the span of ``b`` in the same place."""
    x, y = eight_bytes(a), eight_bytes(b)
    left = (a_ends - a_starts).astype(np.int64)
    same = left == b_ends - b_starts
    live = np.flatnonzero(same)
    p, q, left = a_starts[live], b_starts[live], left[live]
    while len(live):
        equal = ((x[p] ^ y[q]) & low_bytes(left)) == 0
        same[live[~equal]] = False
        more = equal & (left > 8)
        live, p, q, left = live[more], p[more] + 8, q[more] + 8, left[more] - 8
    return same


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; entry i covers words i to i+n-1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, SEED, np.uint64)
    for k in range(n):
        out = out * M1 + h[k : k + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def sliced(batches, column: str, limit: int = 1 << 20):
    """Re-cut record batches so that each holds about ``limit`` bytes of ``column`` (one row at least), which bounds a task's arrays."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = string_buffer(batch[column])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def in_small_batches(df):
    """``df``, whose session from now on hands texts to Python in batches of at most 4 MB (Spark's own bound is 64 MB a task, and 10,000 rows)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def shared_folder(spark) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in this process alone (local tests) one is chosen here."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df, eager: bool = True):
    """``df`` read back from the shared folder: executors may be lost, and nothing is computed twice. For small frames."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def small(rows, most_bytes: int = 64 << 20):
    """``rows`` for a join, marked for broadcast if they take at most ``most_bytes``: their columns as text, and 32 bytes a row."""
    size = F.lit(32).cast("bigint")
    for c in rows.columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= most_bytes else rows


class Scratch:
    """Tables written to the shared folder, compressed, and deleted when they have served. What a lazy result still reads stays. Small files are read several in a task."""

    def __init__(self, spark):
        import uuid

        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, df, name: str):
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark) -> None:
    """Lets Spark's cleaner delete shuffle files that nothing refers to any more, rather than at the driver's next full collection.

    To be called after a written table ends a large shuffle; without it a driver that needs little memory keeps all of them on disk.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
