"""Similarity join of word n-gram sets by exact Jaccard, and the components of its links.

Method. A document's set is its distinct n-word shingles as 64-bit hashes. Shingles have a global order, rarest
first: by a bounded table of counts over all documents (``2 ** sketch_bits`` buckets, 4 MB by default), then by hash.
Two sets can be similar only if their prefixes in that order share a shingle. Candidates come from joins on prefix
shingles, then pass the length filter, the positional filter and a suffix filter: sets are cut into parts by hash; where the sizes of a
part differ, some shingle is in one of the two sets only, so the differences of all parts bound the overlap. Where many pairs share a shingle only the parities
of 512 parts are compared at first; every pair then by the sizes of 1024 parts, for which 1 KB a set is shuffled and no whole set.
Each pair that is left is verified once, by its exact overlap.

Equal sets are one class from the start. Within the documents that share a prefix shingle, a star round tests all against one
centre per shingle and length class. What those links connect needs no more tests; all further pairs of different
components are then tested: per shingle, the members outside its largest component against all its members. So no
link between two components is lost, while a group of k near copies costs about k tests rather than k squared.
Star rounds repeat, with other centres, while they still save much of the exact rest.

No task holds a hot group. A pair brings only the partner's set to a centre's: centres with more than ``PAIRS_PER_TASK`` pairs are cut into parts by the partner, and their
own set is sent once a part. In the exact rest a shingle with much work is cut alike. Ids are broadcast below a size in bytes, beyond which the same joins shuffle.
Between steps, ids, pairs and links are written as Parquet: small ones are read back in few tasks, whatever the number of shuffle partitions, as the driver keeps an account of every task.

Null, empty and wordless texts have an empty set and are linked with nothing; with fewer than n words the whole
sequence is the one shingle. Rows that share an id are one node. A null id is its own component (null). Repeated rows
give repeated results. An empty table gives an empty result. Other columns are ignored. A very long text takes memory in proportion to itself; sizes are
64-bit. Ties in the order of shingles don't matter, as it is total: bucket count, then hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import textops
from keyloom.llm.components import components

BLOCKS = 64
PARITY_WORDS = 8
PARTS = 1024
PAIRS_PER_TASK = 256


def shingle_sets(col, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column."""
    buf, off = textops.string_buffer(col)
    buf = textops.lower_table()[buf]
    starts, ends, first = textops.word_spans(buf, off, textops.space_words())
    h = textops.word_hashes(buf, starts, ends)
    grams, out = textops.gram_hashes(h, n), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        else:
            out.append(textops.gram_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list<int64> column of uint64 arrays."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def shingle_counts(texts: DataFrame, n: int, bits: int) -> np.ndarray:
    """How many sets have a shingle of each bucket. Tasks send bucket counts in 64 blocks, summed on executors; the driver gets 2**bits counts."""

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in textops.sliced(batches, "text"):
            g = np.concatenate([*shingle_sets(batch["text"], n), np.zeros(0, np.uint64)])
            total += np.bincount((g >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            parts = np.minimum(total, 2**31 - 1).astype("<u4").reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    rows = textops.in_small_batches(texts.select("text")).mapInArrow(count, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect()
    out = np.zeros((BLOCKS, (1 << bits) // BLOCKS), np.uint32)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, "<u4")
    return out.reshape(-1)


def described(texts: DataFrame, counts, bits: int, n: int, num: int, den: int, kind: str) -> DataFrame:
    """Per row: id, n (set size), sig1, sig2 (equal for equal sets), parity (of the sizes of 512 parts, as bits) and prefix, rarest first."""

    def run(batches):
        table = counts.value
        for batch in textops.sliced(batches, "text"):
            sets = shingle_sets(batch["text"], n)
            prefix, sig, parity = [], np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), PARITY_WORDS), np.uint64)
            for i, g in enumerate(sets):
                if not len(g):
                    prefix.append(g)
                    continue
                keep = len(g) - -(-num * len(g) // den) + 1
                rare = (table[g >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32))
                if keep < len(g):
                    near = np.flatnonzero(rare <= np.partition(rare, keep - 1)[keep - 1])
                    prefix.append(g[near[np.argsort(rare[near], kind="stable")][:keep]])
                else:
                    prefix.append(g[np.argsort(rare, kind="stable")])
                sig[i] = g.sum(), textops.mix(g).sum()
                odd = np.bincount((g & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                parity[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(g) for g in sets], pa.int64()), *(pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64)) for k in (0, 1)), lists(list(parity)), lists(prefix)], ["id", "n", "sig1", "sig2", "parity", "prefix"])

    return textops.in_small_batches(texts).mapInArrow(run, f"id {kind}, n bigint, sig1 bigint, sig2 bigint, parity array<bigint>, prefix array<bigint>")


def full_sets(texts: DataFrame, n: int, kind: str) -> DataFrame:
    """Per row: id and the whole set."""

    def run(batches):
        for batch in textops.sliced(batches, "text"):
            sets = shingle_sets(batch["text"], n)
            yield pa.RecordBatch.from_arrays([batch["id"], lists(sets)], ["id", "grams"])

    return textops.in_small_batches(texts).mapInArrow(run, f"id {kind}, grams array<bigint>")


def part_sizes(texts: DataFrame, n: int, kind: str) -> DataFrame:
    """Per row: id, n (set size) and parts, the sizes of ``PARTS`` parts of the set as bytes. Sizes over 255 count as 255, which can only make differences smaller."""

    def run(batches):
        for batch in textops.sliced(batches, "text"):
            sets = shingle_sets(batch["text"], n)
            parts = [np.minimum(np.bincount((g & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes() for g in sets]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(g) for g in sets], pa.int64()), pa.array(parts, pa.binary())], ["id", "n", "parts"])

    return textops.in_small_batches(texts).mapInArrow(run, f"id {kind}, n bigint, parts binary")


def few_apart(pairs: DataFrame, num: int, den: int, kind: str) -> DataFrame:
    """Suffix filter by part sizes: of rows (a, b, na, nb, pa, pb), the distinct (a, b) whose parts differ by no more than similar sets may."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for c in ("pa", "pb"))
                total = batch["na"].to_numpy() + batch["nb"].to_numpy()
                near = pa.array(np.abs(x - y).sum(1, dtype=np.int64) * (num + den) <= (den - num) * total)
                yield pa.RecordBatch.from_arrays([batch[c].filter(near) for c in ("a", "b")], ["a", "b"])

    return textops.in_small_batches(pairs).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def could_match(num: int, den: int):
    """Length and positional filter of a pair that shares a shingle at places pos and c_pos of sets of n and c_n."""
    length = f"n * {den} >= c_n * {num} and c_n * {den} >= n * {num}"
    return f"{length} and (least(pos, c_pos) + 1 + least(n - 1 - pos, c_n - 1 - c_pos)) * {num + den} >= {num} * (n + c_n)"


def few_odd_parts(num: int, den: int) -> str:
    """Suffix filter: no more parts differ in parity than similar sets of these sizes can have shingles apart."""
    odd = " + ".join(f"bit_count(parity[{k}] ^ c_parity[{k}])" for k in range(PARITY_WORDS))
    return f"({odd}) * {num + den} <= {den - num} * (n + c_n)"


def within(rows: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows whose id is in ``ids`` (distinct). Ids of up to ``most`` bytes are broadcast, so that rows stay where they are; more are joined by shuffle."""
    return rows.join(textops.small(ids, most), "id", "left_semi")


def heavy_sides(pairs: DataFrame, scratch: textops.Scratch, name: str) -> DataFrame:
    """(side, id, parts) of ids with more than PAIRS_PER_TASK pairs on one side: at most one for each that many pairs."""
    ends = pairs.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("id")) for s in ("a", "b")))).alias("e")).groupBy("e.side", "e.id").count()
    return scratch.save(ends.where(F.col("count") > PAIRS_PER_TASK).select("side", "id", F.ceil(F.col("count") / PAIRS_PER_TASK).cast("bigint").alias("parts")), name)


def attached(pairs: DataFrame, sets: DataFrame, side: str, heavy: DataFrame, most: int) -> DataFrame:
    """``pairs`` with the row of ``sets`` (one an id) for their end ``side``; ids that are heavy there are cut by the other end."""
    mine = heavy.where(F.col("side") == side).select(F.col("id").alias(side), "parts")
    if not mine.head(1):
        return pairs.join(sets, side)
    mine = textops.small(mine, most)
    other = "b" if side == "a" else "a"
    cut = pairs.join(mine, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
    copies = sets.join(mine, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return cut.join(copies, [side, "part"]).drop("part")


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int, kind: str, most: int, scratch: textops.Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar, as table ``name``. Whole sets are made, and shuffled, only for texts in pairs that part sizes allow."""
    steps = [f"{name}-{x}" for x in ("ids", "parts", "heavy", "near", "a", "b")]
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), steps[0])
    parts = scratch.save(part_sizes(within(texts, ids, most), n, kind), steps[1])
    heavy = heavy_sides(pairs, scratch, steps[2])

    def side(s: str) -> DataFrame:
        return parts.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("parts").alias(f"p{s}"))

    both = attached(attached(pairs, side("b"), "b", heavy, most), side("a"), "a", heavy, most)
    near = scratch.save(few_apart(both.select("a", "b", "na", "nb", "pa", "pb"), num, den, kind), steps[3])

    def sets(s: str) -> DataFrame:
        made = full_sets(within(texts, scratch.save(near.select(F.col(s).alias("id")).distinct(), f"{name}-{s}"), most), n, kind)
        return made.select(F.col("id").alias(s), F.col("grams").alias(f"g{s}"))

    both = attached(attached(near, sets("b"), "b", heavy, most), sets("a"), "a", heavy, most)
    total = F.size("ga").cast("bigint") + F.size("gb")
    found = scratch.save(both.where(F.size(F.array_intersect("ga", "gb")).cast("bigint") * (num + den) >= num * total).select("a", "b").distinct(), name)
    scratch.drop(*steps)
    return found


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).where("a <> b").distinct()


def join(docs: DataFrame, *, id_col="doc_id", text_col="text", n=4, num=85, den=100, sketch_bits=20, broadcast_bytes=64 << 20, rest_factor=4, crowd=400, work_per_task=1_000_000) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the least id reachable by links, its own included).

    ``num / den`` is the least similarity. ``sketch_bits`` bounds the table of counts. Ids of up to ``broadcast_bytes``
    are broadcast to pick their rows; more are joined by shuffle. Star rounds end when the exact rest has at most
    ``rest_factor`` pairs per candidate posting before any filter, or when the last round saved less than a third of it. In the exact
    rest, the suffix filter is for shingles with more than ``crowd`` such pairs, and those with more than ``work_per_task`` are cut into parts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(texts, n, sketch_bits))
    scratch = textops.Scratch(spark)
    made = scratch.save(described(texts, counts, sketch_bits, n, num, den, kind), "described")
    counts.destroy()
    key = ["n", "sig1", "sig2"]
    base = made.select("id", *key)
    classes = scratch.save(base.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep")), "classes")
    reps = scratch.save(classes.select(F.col("rep").alias("id")).distinct(), "reps")
    postings = within(made, reps, broadcast_bytes)
    postings = postings.select("id", "n", F.posexplode("prefix").alias("pos", "gram")).withColumn("pos", F.col("pos").cast("bigint"))
    shared = postings.groupBy("gram").count().where("count > 1").select("gram")
    postings = scratch.save(postings.join(shared, "gram"), "postings")  # only those whose shingle some other set has in its prefix
    del shared
    scratch.drop("reps")
    textops.free_shuffles(spark)
    step = math.log(den / num)
    postings = postings.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / step))
    total = postings.count()

    labelled = postings.withColumn("comp", F.col("id"))
    links = tested = None
    labels = spark.createDataFrame([], f"node {kind}, component {kind}")
    round_no, work, grew = 0, None, False
    while total:
        final = False
        if round_no:
            known = textops.small(labels, broadcast_bytes)
            labelled = scratch.save(postings.join(known, postings["id"] == known["node"], "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component"), f"labelled{round_no}")
            per_gram = labelled.groupBy("gram", "comp").count().groupBy("gram").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("comps")).where("comps > 1")
            open_grams = scratch.save(per_gram.select("gram", F.col("top.comp").alias("top"), ((F.col("all") - F.col("top.count")) * F.col("all")).alias("work")), f"open{round_no}")
            before, work = work, open_grams.agg(F.sum("work")).first()[0] or 0
            if not work:
                break
            labelled = labelled.join(open_grams.select("gram", "top", (F.col("work") > crowd).alias("crowded"), F.greatest(F.lit(1), F.ceil(F.col("work") / work_per_task)).cast("bigint").alias("parts")), "gram")
            final = work <= rest_factor * total or not grew or (before is not None and 3 * work > 2 * before)
        if final:
            def tests(rows: DataFrame, *more: str) -> DataFrame:
                part = F.pmod(F.xxhash64("id"), "parts").alias("part")
                others = rows.select("gram", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"c_{c}") for c in ("id", "n", "pos", "comp", *more)))
                both = rows.where("comp <> top").withColumn("part", part).join(others, ["gram", "part"]).where("comp <> c_comp").where(could_match(num, den))
                return (both.where(few_odd_parts(num, den)) if more else both).select("id", "c_id")

            busy = labelled.where("crowded")
            parity = within(made.select("id", "parity"), scratch.save(busy.select("id").distinct(), "busy"), broadcast_bytes)
            pairs = tests(labelled.where("not crowded")).union(tests(busy.join(parity, "id"), "parity"))
        else:
            pick = F.min(F.struct(F.xxhash64("comp", F.lit(round_no)), "comp", F.xxhash64("id", F.lit(round_no)), "id", "n", "pos")) if round_no else F.min(F.struct("id", "n", "pos", "comp"))
            centres = labelled.groupBy("gram", "size").agg(pick.alias("c"), F.count("*").alias("k")).where("k > 1").select("gram", "size", *(F.col(f"c.{c}").alias(f"c_{c}") for c in ("id", "n", "pos", "comp")))
            pairs = labelled.join(centres, ["gram", "size"]).where("comp <> c_comp").where(could_match(num, den))
        pairs = ordered(pairs)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs{round_no}")
        textops.free_shuffles(spark)
        new = verified(pairs, texts, n, num, den, kind, broadcast_bytes, scratch, f"links{round_no}")
        grew = bool(new.head(1))
        textops.free_shuffles(spark)
        tested = pairs if tested is None else tested.union(pairs)
        links = new if links is None else links.union(new)
        if round_no:
            scratch.drop(f"labelled{round_no}", f"open{round_no}")
        if grew:
            labels = scratch.save(components(links), f"labels{round_no}")
            textops.free_shuffles(spark)
        round_no += 1
        if final:
            break
    scratch.drop("postings", "busy", *(f"{x}{k}" for x in ("labelled", "open", "pairs", "links") for k in range(round_no + 1)))
    named = classes.select(*key, "rep").join(labels, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    result = base.select("id", *key).join(named, key, "left")
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
