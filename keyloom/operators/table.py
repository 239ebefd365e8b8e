"""A DataFrame as an ordered map or multimap: lookups, moves, scans, counts and ranges.

Keys and values are lists of columns; the order is that of the key, then (in a multimap) of the value. Pairs of a multimap are
distinct. Rows with a null in a key column aren't part of the table. Results are lazy DataFrames; "no such row" is a null column
or an absent row, as each method says.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import modes
from keyloom.plans import ordered
from keyloom.status import ENODATA, NOTFOUND, StoreError


@dataclass
class OrderedTable:
    df: DataFrame
    key: list[str]
    value: list[str] = field(default_factory=list)
    key_mode: str = "usual"
    value_mode: str = "single"
    rows_per_bucket: int = ordered.ROWS_PER_BUCKET
    most_buckets: int = ordered.MOST_BUCKETS

    def __post_init__(self):
        self.key, self.value = list(self.key), list(self.value)
        self.df = self.df.select(*self.key, *self.value).dropna(subset=self.key)

    @property
    def multi(self) -> bool:
        return modes.is_multi(self.value_mode)

    @property
    def key_order(self) -> list[Column]:
        return [modes.sort_key(F.col(c), self.key_mode) for c in self.key]

    @property
    def value_order(self) -> list[Column]:
        return [modes.sort_key(F.col(c), self.value_mode) for c in self.value] if self.multi else []

    @property
    def order(self) -> list[Column]:
        return self.key_order + self.value_order

    @property
    def _size(self) -> dict:
        return {"rows_per_bucket": self.rows_per_bucket, "most": self.most_buckets}

    def _pair(self) -> Column:
        return F.struct(*self.key, *self.value)

    def _like(self, df: DataFrame) -> OrderedTable:
        return OrderedTable(df, self.key, self.value, self.key_mode, self.value_mode, self.rows_per_bucket, self.most_buckets)

    # Ends and scans

    def first(self) -> DataFrame:
        """The first pair, or no row."""
        return self._end(F.min_by)

    def last(self) -> DataFrame:
        """The last pair, or no row."""
        return self._end(F.max_by)

    def _end(self, by) -> DataFrame:
        one = self.df.agg(by(self._pair(), ordered.key_struct(self.order)).alias("p")).where("p is not null")
        return one.select("p.*")

    def scan(self, where: Column | None = None, *, backward: bool = False, start: tuple | None = None, nodup: bool = False, limit: int | None = None) -> DataFrame:
        """Pairs in order, from ``start`` (a key or pair prefix, inclusive) on, where ``where`` holds.

        With ``nodup`` a key gives one pair, the first it would be met at: the first value forward, the last backward.
        ``limit=1`` is find-first; a condition on columns reaches the file scan.
        """
        df = self.df
        if start is not None:
            here = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(self.order[: len(start)])))
            there = F.struct(*(modes.sort_key(F.lit(v), self.key_mode if i < len(self.key) else self.value_mode).cast(df.schema[(self.key + self.value)[i]].dataType).alias(f"_{i}") for i, v in enumerate(start)))
            if len(start) == 1 and self.key_mode != "reverse":  # a plain comparison is pushed down to the files
                here, there = F.col(self.key[0]), F.lit(start[0])
            df = df.where(here <= there if backward else here >= there)
        if nodup and self.multi:
            df = self._like(df).first_values(last=backward)
        if where is not None:
            df = df.where(where)
        keys = [c.desc() for c in self.order] if backward else self.order
        df = df.orderBy(*keys)
        return df if limit is None else df.limit(limit)

    def scan_status(self, verdict: Column, *, backward: bool = False) -> DataFrame:
        """Find-if with errors: ``verdict`` is 'FALSE' to go on, 'TRUE' for a match, anything else an error. The first pair in order that isn't FALSE, with it."""
        return self.df.withColumn("verdict", verdict).where(F.coalesce("verdict", F.lit("FALSE")) != "FALSE").orderBy(*([c.desc() for c in self.order] if backward else self.order)).limit(1)

    def batch(self, after: tuple | None, n: int) -> DataFrame:
        """The next n pairs after a key (keyset paging: no offset is counted)."""
        if self.multi:
            raise StoreError("INCOMPATIBLE", "batches are for maps")
        df = self.df
        if after is not None:
            df = df.where(F.col(self.key[0]) > F.lit(after[0])) if len(self.key) == 1 and self.key_mode != "reverse" else df.where(ordered.key_struct(self.key_order) > F.struct(*(F.lit(v).alias(f"_{i}") for i, v in enumerate(after))))
        return df.orderBy(*self.key_order).limit(n)

    # Places

    def positions(self, name: str = "position") -> DataFrame:
        """Pairs with their 0-based place."""
        return ordered.with_position(self.df, self.order, name, **self._size)

    def scroll(self, n: int, start: int = 0) -> DataFrame:
        """The pair n places after place ``start`` (before, if negative); no row past either end."""
        return ordered.at_places(self.df, self.order, lambda rows: [start + n], **self._size)

    def distance(self, a: tuple | None, b: tuple | None) -> int:
        """Pairs from key a (the first, if None) up to before key b (the end, if None); negative if b is before a."""
        if a is None and b is None:
            raise StoreError("EINVAL", "one end must be given")
        if a is not None and b is not None and a > b:
            return -self.distance(b, a)
        df = self.df
        for end, above in ((a, True), (b, False)):
            if end is not None:
                here = ordered.key_struct(self.order[: len(end)]) if len(end) > 1 else self.order[0]
                there = F.struct(*(F.lit(v).alias(f"_{i}") for i, v in enumerate(end))) if len(end) > 1 else F.lit(end[0])
                df = df.where(here >= there if above else here < there)
        return df.count()

    def distribute(self, n: int) -> DataFrame:
        """n pairs that cut the table into even stretches, with ``slot``: the pairs at places floor(slot * rows / n). Fewer if there are fewer rows."""
        slots: dict[int, int] = {}

        def wanted(rows: int):
            for i in range(n if rows else 0):
                slots.setdefault(i * rows // n, i)
            return slots

        found = ordered.at_places(self.df, self.order, wanted, **self._size)
        slot = F.create_map(*(F.lit(x) for place in slots.items() for x in place))[F.col("position")] if slots else F.lit(None)
        return found.withColumn("slot", slot.cast("int"))

    def estimates(self, ranges: list[tuple], sample: int = 10_000) -> list[int]:
        """Rough counts of pairs with a <= key < b for many ranges (a, b), either of which may be None: one count of rows, of which files keep a number, and one bounded
        sample of first key columns answer them all. The standard error is below rows / (2 * sqrt(sample))."""
        rows = self.df.count()
        key = self.order[0].alias("k")
        picked = self.df.select(key).sample(False, min(1.0, 1.2 * sample / max(1, rows)), 11).limit(2 * sample)
        inside = []
        for a, b in ranges:
            hit = F.lit(True)
            for end, above in ((a, True), (b, False)):
                if end is not None:
                    there = F.lit(end[0] if isinstance(end, tuple) else end)
                    hit = hit & (F.col("k") >= there if above else F.col("k") < there)
            inside.append(F.sum(hit.cast("bigint")))
        got = picked.agg(F.count("*"), *inside).first()
        return [round((x or 0) * rows / max(1, got[0])) for x in got[1:]]

    def estimate(self, a: tuple | None, b: tuple | None, sample: int = 10_000) -> int:
        """As ``estimates``, for one range."""
        return self.estimates([(a, b)], sample)[0]

    # Moves

    def _moved(self, name: str, forward: bool) -> DataFrame:
        return ordered.with_neighbour(self.df, self.order, self._pair(), name, forward=forward, **self._size)

    def next(self, name: str = "next") -> DataFrame:
        """Pairs with the following pair as a struct."""
        return self._moved(name, True)

    def previous(self, name: str = "previous") -> DataFrame:
        return self._moved(name, False)

    def next_dup(self, name: str = "next", forward: bool = True) -> DataFrame:
        """Pairs with the following pair of the same key; a large key is cut into ranges like any other stretch."""
        same = F.lit(True)
        for c in self.key:
            same = same & (F.col(f"{name}.{c}") == F.col(c))
        return self._moved(name, forward).withColumn(name, F.when(same, F.col(name)))

    def previous_dup(self, name: str = "previous") -> DataFrame:
        return self.next_dup(name, False)

    def first_values(self, last: bool = False) -> DataFrame:
        """One pair per key: its first value (or last)."""
        by = F.max_by if last else F.min_by
        return self.df.groupBy(*self.key).agg(by(F.struct(*self.value), ordered.key_struct(self.value_order or [F.lit(0)])).alias("_v")).select(*self.key, "_v.*")

    def next_nodup(self, name: str = "next") -> DataFrame:
        """Keys with the first pair of the following key."""
        t = OrderedTable(self.first_values(), self.key, self.value, self.key_mode, "single", self.rows_per_bucket, self.most_buckets)
        return t.next(name).select(*self.key, name)

    def previous_nodup(self, name: str = "previous") -> DataFrame:
        """Keys with the last pair of the preceding key."""
        t = OrderedTable(self.first_values(last=True), self.key, self.value, self.key_mode, "single", self.rows_per_bucket, self.most_buckets)
        return t.previous(name).select(*self.key, name)

    def ends(self) -> DataFrame:
        """Pairs with on_first, on_last, on_first_dup and on_last_dup."""
        first = self.df.agg(F.min(ordered.key_struct(self.order)).alias("_a"), F.max(ordered.key_struct(self.order)).alias("_z"))
        edges = F.broadcast(first)  # one row
        keyed = self.df.groupBy(*self.key).agg(F.min(ordered.key_struct(self.order)).alias("_ka"), F.max(ordered.key_struct(self.order)).alias("_kz"))
        here = ordered.key_struct(self.order)
        out = self.df.join(keyed, self.key).join(edges, F.lit(True))
        return out.select(*self.key, *self.value, (here == F.col("_a")).alias("on_first"), (here == F.col("_z")).alias("on_last"), (here == F.col("_ka")).alias("on_first_dup"), (here == F.col("_kz")).alias("on_last_dup"))

    def pages(self, size: int) -> DataFrame:
        """Values of each key in pages of ``size``: key, page (from 0), values in order. Rows a page, never a key, are collected."""
        placed = self.positions("_at")
        heads = placed.groupBy(*self.key).agg(F.min("_at").alias("_head"))
        cut = placed.join(heads, self.key).withColumn("page", F.floor((F.col("_at") - F.col("_head")) / size).cast("bigint"))
        item = F.struct("_at", F.struct(*self.value).alias("v"))
        return cut.groupBy(*self.key, "page").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias("values"))

    # Lookups of a batch of probes

    def _on(self, probes: DataFrame, names: list[str], columns: list[str]) -> Column:
        on = F.lit(True)
        for p, c in zip(names, columns, strict=True):
            on = on & (probes[p] == F.col(f"_t_{c}"))
        return on

    def get(self, probes: DataFrame, key: list[str], *, count: bool = False, name: str = "found") -> DataFrame:
        """Probes with the first value of their key as a struct (null if absent) and, with ``count``, how many it has (0 if absent)."""
        if self.multi:
            one = self.df.groupBy(*self.key).agg(F.min_by(F.struct(*self.value), ordered.key_struct(self.value_order)).alias("_v"), F.count("*").alias("_n"))
        else:
            one = self.df.select(*self.key, F.struct(*self.value).alias("_v"), F.lit(1).cast("bigint").alias("_n"))
        one = one.select(*(F.col(c).alias(f"_t_{c}") for c in self.key), F.col("_v").alias(name), "_n")
        out = probes.join(one, self._on(probes, key, self.key), "left").drop(*(f"_t_{c}" for c in self.key))
        return out.withColumn("_n", F.coalesce("_n", F.lit(0))).withColumnRenamed("_n", "values") if count else out.drop("_n")

    def get_default(self, probes: DataFrame, key: list[str], default: Column, name: str = "found") -> DataFrame:
        """As ``get`` with the first value column itself, or ``default``."""
        return self.get(probes, key, name=name).withColumn(name, F.coalesce(F.col(f"{name}.{self.value[0]}"), default))

    def seek(self, probes: DataFrame, key: list[str], value: list[str] | None = None, *, absent: bool = False) -> DataFrame:
        """The probes whose key (or pair) is in the table, or isn't."""
        cols = self.key + (self.value if value else [])
        one = self.df.select(*(F.col(c).alias(f"_t_{c}") for c in cols))
        return probes.join(one, self._on(probes, key + (value or []), cols), "left_anti" if absent else "left_semi")

    def nearest(self, probes: DataFrame, key: list[str], op: str, value: list[str] | None = None, *, within: bool = False, name: str = "found") -> DataFrame:
        """Probes with the pair that a positioning finds, as a struct, or null.

        ``op`` is one of lt, le, eq, ge, gt. With ``value`` pairs are compared; with ``within`` the key must be equal and values are compared.
        By key alone, a key with several values is met at its first one.
        """
        if op not in ("lt", "le", "eq", "ge", "gt"):
            raise StoreError("EINVAL", op)
        if op == "eq":
            cols = self.key + (self.value if value else [])
            src = self.df if value or not self.multi else self.first_values()
            one = src.select(*(F.col(c).alias(f"_t_{c}") for c in cols), self._pair().alias(name))
            return probes.join(one, self._on(probes, key + (value or []), cols), "left").drop(*(f"_t_{c}" for c in cols))
        src = self.df if value or not self.multi else self.first_values()
        mine = self.key_order + (self.value_order if value else [])
        theirs = [modes.sort_key(F.col(c), self.key_mode) for c in key] + [modes.sort_key(F.col(c), self.value_mode) for c in value or []]
        return ordered.lookup(src, probes, list(zip(mine, theirs, strict=True)), self._pair(), name, floor=op in ("lt", "le"), strict=op in ("lt", "gt"), prefix=len(self.key) if within else 0, **self._size)

    def lower_bound(self, probes: DataFrame, key: list[str], value: list[str] | None = None, name: str = "found") -> DataFrame:
        """The first pair at or after the probe, and ``status``: SUCCESS if exact, RESULT_TRUE if after, NOTFOUND."""
        out = self.nearest(probes, key, "ge", value, name=name)
        exact = F.lit(True)
        for p, c in zip(key + (value or []), self.key + (self.value if value else []), strict=True):
            exact = exact & (F.col(p) == F.col(f"{name}.{c}"))
        return out.withColumn("status", F.when(F.col(name).isNull(), NOTFOUND).when(exact, "SUCCESS").otherwise("RESULT_TRUE"))

    def upper_bound(self, probes: DataFrame, key: list[str], value: list[str] | None = None, name: str = "found") -> DataFrame:
        """The first pair after the probe, or null."""
        return self.nearest(probes, key, "gt", value, name=name)

    def compare(self, a: DataFrame, b: DataFrame, on: list[str], *, ignore_values: bool = False, name: str = "order") -> DataFrame:
        """Positions of two cursors, joined by ``on``: -1, 0 or 1 as a's pair (or key) is before, at or after b's."""
        cols = self.key + ([] if ignore_values else self.value)
        x = a.select(*on, F.struct(*(c.alias(f"_{i}") for i, c in enumerate(self.key_order + ([] if ignore_values else self.value_order)))).alias("_a"), F.struct(*cols).alias("a"))
        y = b.select(*on, F.struct(*(c.alias(f"_{i}") for i, c in enumerate(self.key_order + ([] if ignore_values else self.value_order)))).alias("_b"), F.struct(*cols).alias("b"))
        both = x.join(y, on)
        return both.select(*on, "a", "b", F.when(F.col("_a") < F.col("_b"), -1).when(F.col("_a") == F.col("_b"), 0).otherwise(1).alias(name))

    # Ranges to delete

    def delete_range(self, begin: tuple | None, end: tuple | None, *, end_included: bool = False, counted: bool = True) -> tuple[OrderedTable, int | None]:
        """(the table without pairs from begin up to end, how many those were if they are to be ``counted``). None is either end of the table; begin after end is ENODATA."""
        if begin is not None and end is not None and tuple(begin) > tuple(end):
            raise StoreError(ENODATA, "begin is after end")
        inside = F.lit(True)
        for side, low in ((begin, True), (end, False)):
            if side is None:
                continue
            here = self.order[0] if len(side) == 1 else ordered.key_struct(self.order[: len(side)])
            there = F.lit(side[0]) if len(side) == 1 else F.struct(*(F.lit(v).alias(f"_{i}") for i, v in enumerate(side)))
            inside = inside & (here >= there if low else here <= there if end_included else here < there)
        return self._like(self.df.where(~inside)), self.df.where(inside).count() if counted else None

    def bunch(self, what: str, pair: tuple) -> Column:
        """The condition for the pairs that a bunch deletion at position ``pair`` (key, then value) takes."""
        nk = len(self.key)
        key = F.lit(True)
        for c, v in zip(self.key, pair[:nk], strict=True):
            key = key & (F.col(c) == F.lit(v))
        here = ordered.key_struct(self.order)
        there = F.struct(*(F.lit(v).alias(f"_{i}") for i, v in enumerate(pair)))
        rules = {
            "current_value": here == there, "multival_before_excluding": key & (here < there), "multival_before_including": key & (here <= there),
            "multival_after_including": key & (here >= there), "multival_after_excluding": key & (here > there), "multival_all": key,
            "before_excluding": here < there, "before_including": here <= there, "after_including": here >= there, "after_excluding": here > there, "whole": F.lit(True),
        }
        if what not in rules:
            raise StoreError("EINVAL", what)
        return rules[what]

    def bunch_delete(self, what: str, pair: tuple, *, counted: bool = True) -> tuple[OrderedTable, int | None]:
        """(what stays, how many went if they are to be ``counted``)."""
        gone = self.bunch(what, pair)
        return self._like(self.df.where(~gone)), self.df.where(gone).count() if counted else None
