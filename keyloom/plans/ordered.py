"""Positions, neighbours and floor / ceiling lookups over a total order, in parallel.

A window without PARTITION BY runs in one task. Here rows are cut into buckets that are ranges of the order (split points
come from a bounded sample), windows run inside buckets, and what crosses a border is carried: one small aggregate row per
bucket, summed or scanned over buckets and broadcast back (as many rows as buckets). Each operator shuffles its rows once.

A lookup of few probes doesn't shuffle its table at all: every row finds the gap between probes that it lies in, and the best row of each gap is an
aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket aimed at, and the most buckets; both are parameters of the tables that use them.
ROWS_PER_BUCKET, MOST_BUCKETS = 250_000, 32_768
#: Cuts that are compared in an expression, and stretches of a table between which a row is told at each further level.
COARSE, MOST_COARSE = 8, 8
#: Sampled rows for each bucket, and in all.
SAMPLE, MOST_SAMPLED = 50, 500_000
#: Up to so many probes are collected to see whether they are few, and up to so many distinct ones are few.
MOST_ROWS_ASKED, FEW_PROBES = 20_000, 1024
#: A key with more rows than this is cut into parts where rows meet the one row of their key.
ROWS_PER_PART = 1_000_000


def key_struct(order: list[Column]) -> Column:
    return F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))


def bucket_count(rows: int, rows_per_bucket: int, most: int) -> int:
    return max(1, min(most, math.ceil(rows / rows_per_bucket)))


def sampled_cuts(df: DataFrame, order: list[Column], rows_per_bucket: int = ROWS_PER_BUCKET, most: int = MOST_BUCKETS, rows: int | None = None) -> list:
    """As ``split_points``, with a key as often as it cuts: twice or more if it has about a bucket's rows or more."""
    n = df.count() if rows is None else rows
    buckets = bucket_count(n, rows_per_bucket, most)
    if buckets <= 1:
        return []
    picked = df.select(key_struct(order).alias("k")).sample(False, min(1.0, min(SAMPLE * buckets, MOST_SAMPLED) / n), 7).repartition(1).sortWithinPartitions("k").collect()  # an orderBy would read everything once more
    return [picked[len(picked) * i // buckets].k for i in range(1, buckets)] if picked else []


def distinct_cuts(cuts: list) -> list:
    return [k for i, k in enumerate(cuts) if i == 0 or k != cuts[i - 1]]


def split_points(df: DataFrame, order: list[Column], rows_per_bucket: int = ROWS_PER_BUCKET, most: int = MOST_BUCKETS, rows: int | None = None) -> list:
    """Sorted order keys that cut ``df`` into buckets of about equal size; the sample has about SAMPLE rows a bucket, and MOST_SAMPLED at most. ``rows`` is their number, if it is known."""
    return distinct_cuts(sampled_cuts(df, order, rows_per_bucket, most, rows))


def above(key: list[Column], cut: list[Column], at: bool) -> Column:
    """Whether a key is above a cut (or ``at`` it), nulls first: plain comparisons, of which most rows need the first."""
    out = F.lit(at)
    for k, c in reversed(list(zip(key, cut, strict=True))):
        out = F.coalesce(k > c, k.isNotNull() & c.isNull()) | (k.eqNullSafe(c) & out)
    return out


def bucket(df: DataFrame, order: list[Column], cuts: list, *, at: bool = True) -> Column:
    """The number of cuts at or below a row's key (below it, unless ``at``): a comparison for each cut, so for few of them."""
    if not cuts:
        return F.lit(0)
    kinds = [f.dataType for f in df.select(key_struct(order).alias("k")).schema["k"].dataType.fields]
    total = F.lit(0)
    for k in cuts:
        total = total + above(order, [F.lit(v).cast(t) for v, t in zip(k, kinds, strict=True)], at).cast("int")
    return total


def in_buckets(df: DataFrame, order: list[Column], cuts: list, *, at: bool = True) -> DataFrame:
    """``df`` with its bucket ``_b``, the number of cuts at or below a row's key (below it, unless ``at``).

    Few cuts are compared one by one. Of more, every so manieth is, and the stretches between come from small broadcast tables, one for each level
    of a tree, at each of which a row meets MOST_COARSE stretches: steps grow with the logarithm of the number of cuts.
    """
    if len(cuts) <= COARSE:
        return df.withColumn("_b", bucket(df, order, cuts, at=at))
    size, ends = 1, [None, *cuts, None]
    while len(cuts) // size > COARSE:
        size *= MOST_COARSE
    kind = df.select(key_struct(order).alias("k")).schema["k"].dataType.simpleString()
    places = range(len(order))
    key, lo, hi = ([F.col(f"{c}{i}") for i in places] for c in ("_key", "_lo", "_hi"))
    rows = df.withColumns({f"_key{i}": c for i, c in enumerate(order)})
    rows = rows.withColumn("_b", bucket(rows, key, cuts[size - 1 :: size], at=at))
    while size > 1:
        step = size // MOST_COARSE
        made = [(i // size, ends[i], ends[min(i + step, len(cuts) + 1)], i // step) for i in range(0, len(cuts) + 1, step)]
        table = df.sparkSession.createDataFrame(made, f"_c int, _lo {kind}, _hi {kind}, _n int")
        table = table.select("_c", "_n", F.col("_lo").isNull().alias("_first"), F.col("_hi").isNull().alias("_last"), *(F.col(f"{c}._{i}").alias(f"{c}{i}") for c in ("_lo", "_hi") for i in places))
        inside = (F.col("_first") | above(key, lo, at)) & (F.col("_last") | ~above(key, hi, at))
        rows = rows.join(F.broadcast(table), (F.col("_b") == F.col("_c")) & inside).withColumn("_b", F.col("_n")).drop(*table.columns)
        size = step
    return rows.drop(*(f"_key{i}" for i in places))


def bucketed(df: DataFrame, order: list[Column], rows_per_bucket: int = ROWS_PER_BUCKET, most: int = MOST_BUCKETS, rows: int | None = None) -> tuple[DataFrame, int]:
    """(``df`` with its bucket ``_b``, the number of buckets); buckets are numbered in the order. ``rows``: their number, or an upper bound, if known."""
    cuts = split_points(df, order, rows_per_bucket, most, rows)
    return in_buckets(df, order, cuts), len(cuts) + 1


def _bases(rows: DataFrame) -> DataFrame:
    """(_b, _n, _base): the rows of each bucket, and of all buckets before it."""
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    return counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def with_position(df: DataFrame, order: list[Column], name: str = "position", **size) -> DataFrame:
    """Adds the 0-based place of each row in the order (ties in no particular order, so give a total order)."""
    rows, buckets = bucketed(df, order, **size)
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order)).cast("bigint") - 1
    if buckets == 1:
        return rows.withColumn(name, local).drop("_b")
    return rows.withColumn("_local", local).join(F.broadcast(_bases(rows).drop("_n")), "_b").withColumn(name, F.col("_local") + F.col("_base")).drop("_b", "_local", "_base")


def at_places(df: DataFrame, order: list[Column], wanted, name: str = "position", **size) -> DataFrame:
    """The rows at some places, with their place. ``wanted(rows)`` gives the places for a number of rows. Buckets are counted first; only those that hold such a place are sorted."""
    rows, _ = bucketed(df, order, **size)
    bases = _bases(rows).orderBy("_b").collect()  # one row a bucket
    places = set(wanted(sum(r["_n"] for r in bases)))
    held = {r["_b"]: r["_base"] for r in bases if any(r["_base"] <= p < r["_base"] + r["_n"] for p in places)}
    base = F.create_map(*(F.lit(x) for b in held.items() for x in b))[F.col("_b")] if held else F.lit(0)
    some = rows.where(F.col("_b").isin(list(held)))
    placed = some.withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy(*order)).cast("bigint") - 1 + base)
    return placed.where(F.col(name).isin(list(places))).drop("_b")


def with_neighbour(df: DataFrame, order: list[Column], payload: Column, name: str, *, forward: bool = True, like: DataFrame | None = None, **size) -> DataFrame:
    """Adds the payload of the next (or previous) row in the order; null at the end. ``like``: rows with about the same keys that are cheaper to read, for the split points."""
    cuts = split_points(df if like is None else like, order, **size)
    rows, buckets = in_buckets(df, order, cuts), len(cuts) + 1
    rows = rows.withColumn("_p", payload)
    inside = Window.partitionBy("_b").orderBy(*order)
    near = (F.lead if forward else F.lag)("_p").over(inside)
    if buckets == 1:
        return rows.withColumn(name, near).drop("_b", "_p")
    edge = (F.min_by if forward else F.max_by)("_p", key_struct(order))
    edges = rows.groupBy("_b").agg(edge.alias("_e"))
    over = Window.orderBy("_b")
    edges = edges.select("_b", (F.lead if forward else F.lag)("_e").over(over).alias("_e"))
    return rows.withColumn(name, near).join(F.broadcast(edges), "_b").withColumn(name, F.coalesce(name, "_e")).drop("_b", "_p", "_e")


def meet_one(many: DataFrame, one: DataFrame, on: list[str], count: str, counts: DataFrame | None = None) -> DataFrame:
    """``many`` LEFT JOIN ``one``, which has a row for each ``on`` with the number of rows in ``many``, ``count``. Keys with more than ROWS_PER_PART rows are cut
    into parts, each of which meets a copy of the row; the list of such keys, at most one for each ROWS_PER_PART rows, is broadcast. ``counts``: a frame with these
    numbers that is cheaper to read."""
    parts = F.ceil(F.col(count) / ROWS_PER_PART).cast("bigint")
    heavy = F.broadcast((one if counts is None else counts).where(F.col(count) > ROWS_PER_PART).select(*on, parts.alias("_parts")))
    cut = many.join(heavy, on, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    copies = one.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return cut.join(copies, [*on, "_part"], "left").drop("_part")


def few_keys(probes: DataFrame, keys: list[str], rows: int) -> list | None:
    """The sorted distinct keys of the probes, if these are few."""
    if rows > MOST_ROWS_ASKED or any("timestamp" in t or "interval" in t for _, t in probes.select(*keys).dtypes):  # which Python can't hand back exactly
        return None
    asked = probes.dropna(subset=keys).select(F.struct(*keys).alias("k")).distinct().orderBy("k").limit(FEW_PROBES + 1).collect()
    return [r.k for r in asked] if len(asked) <= FEW_PROBES else None


def lookup_few(rows: DataFrame, asked: list, keys: list[str], *, floor: bool, strict: bool) -> DataFrame:
    """(_k0, ..., _f) for few sorted keys: the nearest row's ``_h``. ``rows`` has the keys and ``_h``; they stay where they are, and one row a gap is shuffled."""
    cols = [F.col(k) for k in keys]
    # a floor is wanted by the first probe that isn't before the row, and by all after it; a ceiling by the last that isn't after it, and all before
    gaps = in_buckets(rows, cols, asked, at=strict if floor else not strict).where(F.col("_b") < len(asked) if floor else F.col("_b") > 0)
    best = gaps.groupBy("_b").agg((F.max_by if floor else F.min_by)("_h", key_struct(cols)).alias("_e"))
    kind = rows.select(*keys).schema
    points = rows.sparkSession.createDataFrame([(j if floor else j + 1, *k) for j, k in enumerate(asked)], "_b int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind))
    over = Window.orderBy("_b")
    carry = F.last("_e", True).over(over.rowsBetween(Window.unboundedPreceding, 0)) if floor else F.first("_e", True).over(over.rowsBetween(0, Window.unboundedFollowing))
    return points.join(F.broadcast(best), "_b", "left").select(*keys, carry.alias("_f"))


def carried(both: DataFrame, rows: DataFrame, keys: list[str], cuts: list, *, floor: bool) -> DataFrame:
    """``both``, of data rows and rows that ask, with ``_f``: the ``_h`` of the nearest data row before (``floor``) or behind in the order of the keys, then ``_s``. ``rows``: the data rows alone."""
    cols = [F.col(k) for k in keys]
    # a frame that grows row by row costs one step a row; one that shrinks would be rebuilt for each, so ceilings walk backwards
    w = Window.partitionBy("_b").orderBy(*(c if floor else c.desc() for c in [*cols, F.col("_s")]))
    found = in_buckets(both, cols, cuts).withColumn("_f", F.last("_h", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not cuts:
        return found.drop("_b", "_h")
    top = F.max_by("_h", key_struct(cols)) if floor else F.min_by("_h", key_struct(cols))
    edges = in_buckets(rows, cols, cuts).groupBy("_b").agg(top.alias("_e"))
    every = rows.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_b")).join(edges, "_b", "left")
    over = Window.orderBy("_b")
    carry = F.last("_e", True).over(over.rowsBetween(Window.unboundedPreceding, -1)) if floor else F.first("_e", True).over(over.rowsBetween(1, Window.unboundedFollowing))
    edge = F.broadcast(every.select("_b", carry.alias("_e")))
    return found.drop("_h").where("_a").join(edge, "_b").withColumn("_f", F.coalesce("_f", "_e")).drop("_b", "_e")


def lookup(data: DataFrame, probes: DataFrame, order: list[tuple[Column, Column]], payload: Column, name: str, *, floor: bool, strict: bool, prefix: int = 0, like: DataFrame | None = None, **size) -> DataFrame:
    """``probes`` with ``name``: the payload of the nearest data row at or below (``floor``) or above the probe, strictly or not; null if none.

    ``order``: pairs of (data column, probe column). The first ``prefix`` of them must be equal for a hit, so a lookup within a key is a lookup in the order
    of (key, value) whose hit has another key or not: large keys are cut like any range. Probes are cut into buckets together with the data, and take their
    answer there. Only where a key has a bucket's rows or more, equal probe keys are looked up once, and a key that very many probes share is cut where they meet
    its answer. A null in a probe key finds nothing. ``like``: rows with the same keys as ``probes`` that are cheaper to read; they are counted and sampled in their place.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    cols = [F.col(k) for k in keys]
    rows = data.select(*(d.alias(k) for (d, _), k in zip(order, keys, strict=True)), payload.alias("_p"))
    tag = lambda x: x.withColumns({k: p for (_, p), k in zip(order, keys, strict=True)})
    tagged = tag(probes)
    asking = tagged.select(*keys) if like is None else tag(like).select(*keys)
    if (kinds := rows.select(*keys).dtypes) != tagged.select(*keys).dtypes:  # compared as a union would
        kinds = rows.select(*keys).limit(0).unionByName(tagged.select(*keys).limit(0)).dtypes
        rows, tagged, asking = (x.withColumns({k: F.col(k).cast(t) for k, t in kinds}) for x in (rows, tagged, asking))
    rows = rows.select(*keys, F.struct(*cols[:prefix], F.col("_p").alias("p")).alias("_h"))
    n = asking.count()
    few = few_keys(asking, keys, n)
    same = F.lit(True)
    for k in keys[:prefix]:
        same = same & (F.col(f"_f.{k}") == F.col(k))
    for k in keys[prefix:]:
        same = same & F.col(k).isNotNull()
    answer = F.when(same, F.col("_f.p")).alias(name)
    if few is not None:
        found = lookup_few(rows, few, keys, floor=floor, strict=strict)
        return tagged.join(F.broadcast(found.select(*keys, answer)), keys, "left").drop(*keys)

    n += data.count()
    cuts = sampled_cuts(rows.select(*keys).unionByName(asking), cols, rows=n, **size)
    hot, cuts = len(distinct_cuts(cuts)) < len(cuts), distinct_cuts(cuts)
    if hot:
        asked = asking.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_asked"))
        cuts = split_points(rows.select(*keys).unionByName(asked.select(*keys)), cols, rows=n, **size)
    else:
        asked = tagged.select(*keys, F.struct(*probes.columns).alias("_row"))
    first = floor != strict  # whether data sorts before equal probes
    both = rows.withColumns({"_s": F.lit(0 if first else 1), "_a": F.lit(False)}).unionByName(asked.withColumns({"_s": F.lit(1 if first else 0), "_a": F.lit(True)}), allowMissingColumns=True)
    found = carried(both, rows, keys, cuts, floor=floor).where("_a")
    if hot:
        return meet_one(tagged, found.select(*keys, answer, "_asked"), keys, "_asked", asked).drop(*keys)
    return found.select("_row.*", answer)
