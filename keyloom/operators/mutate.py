"""Batches of mutations: a table and numbered operations in, the new table and a status for every operation out.

A batch means its operations one after the other, by ``seq``, whose numbers differ. What an operation meets follows from aggregates of its key's operations
(the first and the last number, summed before rows are shuffled) or, in mixed batches, from an ordered lookup that cuts keys with many
operations into ranges. Where operations are joined with what their key has, a key with very many of them is cut into parts, each of which meets a copy of
that one row (``ordered.meet_one``). So no key's operations are gathered in one task, however many there are. Operations with a null in a key do nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom import status
from keyloom.operators.table import OrderedTable
from keyloom.plans.ordered import key_struct, lookup, meet_one, with_neighbour

UPSERT, INSERT, UPDATE, DELETE = "upsert", "insert", "update", "delete"
NODUP, DELETE_KEY = "nodup", "delete_key"
BEFORE_ALL = -(2**63)


def _marked(batch: DataFrame, cols: list[str], *known: DataFrame) -> DataFrame:
    """The batch with ``_is_first`` and ``_is_last`` among the operations of the same ``cols``, and the columns of ``known`` tables (one row for each ``cols``)."""
    ends = batch.dropna(subset=cols).groupBy(*cols).agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"), F.count("*").alias("_ops"))
    for k in known:
        ends = ends.join(k, cols, "left")
    rows = meet_one(batch, ends, cols, "_ops")
    return rows.withColumn("_is_first", F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))).withColumn("_is_last", F.coalesce(F.col("seq") == F.col("_last"), F.lit(False)))


def _there(table: OrderedTable, cols: list[str]) -> DataFrame:
    return table.df.select(*cols).distinct().withColumn("_here", F.lit(True))


def put(table: OrderedTable, batch: DataFrame, kind: str) -> tuple[OrderedTable, DataFrame]:
    """(new table, status) of a batch (seq, key columns, value columns) on a map.

    upsert: the last value of a key wins. insert: the first of an absent key wins, all others are KEYEXIST. update: the last wins if the key is
    there, else NOTFOUND. status has seq, the key, code and ``existing``: the value the operation met in the table before the batch (null if none).
    """
    if table.multi:
        raise status.StoreError(status.INCOMPATIBLE, "use put_multi")
    old = table.df.select(*table.key, F.struct(F.lit(True).alias("_here"), *(F.col(c) for c in table.value)).alias("_old"))
    rows = _marked(batch, table.key, old)
    here = F.col("_old").isNotNull()
    if kind == UPSERT:
        code, wins = F.lit(status.SUCCESS), F.col("_is_last")
    elif kind == INSERT:
        wins = ~here & F.col("_is_first")
        code = F.when(wins, status.SUCCESS).otherwise(status.KEYEXIST)
    elif kind == UPDATE:
        wins = here & F.col("_is_last")
        code = F.when(here, status.SUCCESS).otherwise(status.NOTFOUND)
    else:
        raise status.StoreError(status.EINVAL, kind)
    new = rows.where(wins).select(*table.key, *table.value)
    kept = table.df.join(new.select(*table.key), table.key, "left_anti")
    said = rows.select("seq", *table.key, code.alias("code"), F.when(here, F.struct(*(F.col(f"_old.{c}").alias(c) for c in table.value))).alias("existing"))
    return table._like(kept.unionByName(new)), said


def put_multi(table: OrderedTable, batch: DataFrame, kind: str) -> tuple[OrderedTable, DataFrame]:
    """(new table, status) on a multimap. upsert: adds the pair if it isn't there. nodup: as upsert, but KEYEXIST for a pair that is there or
    came before. insert: only for absent keys; the first pair of a key wins. replace_all: the batch's last value becomes the key's only one.
    update: the last value replaces the one value of a key; EMULTIVAL if it has more, NOTFOUND if it has none.
    """
    pair = table.key + table.value
    if kind in (UPSERT, "nodup"):
        rows = _marked(batch, pair, _there(table, pair))
        fresh = F.col("_here").isNull() & F.col("_is_first")
        code = F.lit(status.SUCCESS) if kind == UPSERT else F.when(fresh, status.SUCCESS).otherwise(status.KEYEXIST)
        return table._like(table.df.unionByName(rows.where(fresh).select(*pair))), rows.select("seq", *pair, code.alias("code"))
    if kind == INSERT:
        rows = _marked(batch, table.key, _there(table, table.key))
        wins = F.col("_here").isNull() & F.col("_is_first")
        return table._like(table.df.unionByName(rows.where(wins).select(*pair))), rows.select("seq", *pair, F.when(wins, status.SUCCESS).otherwise(status.KEYEXIST).alias("code"))
    if kind == "replace_all":
        rows = _marked(batch, table.key)
        code, wins = F.lit(status.SUCCESS), F.col("_is_last")
    elif kind == UPDATE:
        rows = _marked(batch, table.key, table.df.groupBy(*table.key).agg(F.count("*").alias("_n")))
        code = F.when(F.col("_n").isNull(), status.NOTFOUND).when(F.col("_n") > 1, status.EMULTIVAL).otherwise(status.SUCCESS)
        wins = F.col("_is_last") & (F.col("_n") == 1)
    else:
        raise status.StoreError(status.EINVAL, kind)
    new = rows.where(wins).select(*pair)
    kept = table.df.join(new.select(*table.key), table.key, "left_anti")
    return table._like(kept.unionByName(new)), rows.select("seq", *pair, code.alias("code"))


def delete(table: OrderedTable, batch: DataFrame, *, pairs: bool = False) -> tuple[OrderedTable, DataFrame]:
    """(new table, status) for keys, with all their values, or with ``pairs`` for single pairs. The first deletion succeeds, later ones are NOTFOUND."""
    cols = table.key + (table.value if pairs else [])
    rows = _marked(batch.select("seq", *cols), cols, _there(table, cols))
    ok = F.col("_here").isNotNull() & F.col("_is_first")
    return table._like(table.df.join(batch.select(*cols).distinct(), cols, "left_anti")), rows.select("seq", *cols, F.when(ok, status.SUCCESS).otherwise(status.NOTFOUND).alias("code"))


def extract(table: OrderedTable, batch: DataFrame) -> tuple[OrderedTable, DataFrame]:
    """Reads and deletes: as ``delete``, with the first value of each key that was there."""
    new, said = delete(table, batch)
    got = table.get(said, table.key, name="value")
    return new, got.withColumn("value", F.when(F.col("code") == status.SUCCESS, F.col("value")))


def replace_value(table: OrderedTable, batch: DataFrame, *, repeats: bool = False) -> tuple[OrderedTable, DataFrame]:
    """On a multimap, (seq, key, value columns, old_<value> columns): exchanges single pairs. NOTFOUND without the old pair; KEYEXIST if the new one is there.

    With ``repeats`` pairs needn't differ: every row of the old pair is exchanged, whether or not the new one is there, and no row goes.
    """
    old = [f"old_{c}" for c in table.value]
    a = table.df.select(*table.key, *(F.col(c).alias(o) for c, o in zip(table.value, old, strict=True))).withColumn("_a", F.lit(True))
    if repeats:
        rows = _marked(batch, table.key + old, a.distinct())
        code = F.when(F.col("_a").isNull() | ~F.col("_is_first"), status.NOTFOUND).otherwise(status.SUCCESS)
        first = batch.groupBy(*table.key, *old).agg(F.min_by(F.struct(*table.value), "seq").alias("_w"))
        first = first.select(*table.key, *(F.col(o).alias(c) for c, o in zip(table.value, old, strict=True)), "_w")
        met = table.df.join(first, table.key + table.value, "left")
        now = (F.when(F.col("_w").isNull(), F.col(c)).otherwise(F.col(f"_w.{c}")).alias(c) for c in table.value)
        return table._like(met.select(*table.key, *now)), rows.select("seq", *table.key, *old, *table.value, code.alias("code"))
    b = table.df.select(*table.key, *table.value).withColumn("_b", F.lit(True))
    rows = _marked(batch, table.key + old, a).join(b, table.key + table.value, "left")
    code = F.when(F.col("_a").isNull() | ~F.col("_is_first"), status.NOTFOUND).when(F.col("_b").isNotNull(), status.KEYEXIST).otherwise(status.SUCCESS)
    rows = rows.withColumn("code", code)
    done = rows.where(F.col("code") == status.SUCCESS)
    gone = done.select(*table.key, *(F.col(o).alias(c) for c, o in zip(table.value, old, strict=True)))
    kept = table.df.join(gone, table.key + table.value, "left_anti")
    return table._like(kept.unionByName(done.select(*table.key, *table.value)).distinct()), rows.select("seq", *table.key, *old, *table.value, "code")


def put_multiple(table: OrderedTable, key: tuple, values: DataFrame, *, counted: bool = True) -> tuple[OrderedTable, int | None]:
    """Many values of one key at once; (new table, how many were new if they are to be ``counted``)."""
    rows = values.select(*table.value).distinct()
    for c, v in zip(table.key, key, strict=True):
        rows = rows.withColumn(c, F.lit(v).cast(table.df.schema[c].dataType))
    new = rows.join(table.df, table.key + table.value, "left_anti").select(*table.key, *table.value)
    return table._like(table.df.unionByName(new)), new.count() if counted else None


def append(table: OrderedTable, batch: DataFrame) -> OrderedTable:
    """Adds pairs that all come after the last one, in order of ``seq``; EKEYMISMATCH if they don't."""
    t = OrderedTable(batch.select(*table.key, *table.value), table.key, table.value, table.key_mode, table.value_mode)
    last = table.last().collect()
    now = key_struct(table.order)
    wrong = with_neighbour(batch, [F.col("seq")], now, "_prev", forward=False).where(F.col("_prev") >= now)
    if last:
        edge = F.struct(*(F.lit(v).alias(f"_{i}") for i, v in enumerate(last[0][: len(table.order)])))
        wrong = wrong.select("seq").unionByName(batch.where(now <= edge).select("seq"))
    if wrong.head(1):
        raise status.StoreError(status.EKEYMISMATCH)
    return table._like(table.df.unionByName(t.df))


def apply_mixed(table: OrderedTable, batch: DataFrame) -> tuple[OrderedTable, DataFrame]:
    """A mixed batch (seq, op, key columns, value columns) on a map: op is upsert, insert, update or delete, in any order and on the same keys; another op is EINVAL.

    Whether an operation meets its key follows from the nearest operation before it that decides so: after an upsert or insert the key is there, after a
    delete it isn't, and an update changes nothing about it. That is an ordered lookup by (key, seq). The last operation of a key that succeeds gives its value.
    """
    if table.multi:
        raise status.StoreError(status.INCOMPATIBLE, "use apply_mixed_multi")
    key = list(table.key)
    batch = batch.select(F.col("seq").cast("bigint").alias("seq"), "op", *key, *table.value)
    before = table.df.join(batch.select(*key).distinct(), key, "left_semi").select(F.lit(BEFORE_ALL).cast("bigint").alias("seq"), *key, F.lit(True).alias("_live"))
    decide = batch.where(F.col("op").isin(UPSERT, INSERT, DELETE)).select("seq", *key, (F.col("op") != DELETE).alias("_live"))
    order = [(F.col(c), F.col(c)) for c in [*key, "seq"]]
    met = lookup(before.unionByName(decide), batch, order, F.col("_live"), "_met", floor=True, strict=True, prefix=len(key), rows_per_bucket=table.rows_per_bucket)
    here = F.coalesce("_met", F.lit(False))
    code = F.when(F.col("op").isin(UPDATE, DELETE), F.when(here, status.SUCCESS).otherwise(status.NOTFOUND)).when(F.col("op") == INSERT, F.when(here, status.KEYEXIST).otherwise(status.SUCCESS)).when(F.col("op") == UPSERT, status.SUCCESS).otherwise(status.EINVAL)
    done = met.withColumn("code", code)
    last = done.where(F.col("code") == status.SUCCESS).dropna(subset=key).groupBy(*key).agg(F.max_by(F.struct("op", *table.value), "seq").alias("_w"))
    kept = table.df.join(last.select(*key), key, "left_anti")
    new = last.where(F.col("_w.op") != DELETE).select(*key, *(F.col(f"_w.{c}").alias(c) for c in table.value))
    return table._like(kept.unionByName(new)), done.select("seq", *key, "code")


def apply_mixed_multi(table: OrderedTable, batch: DataFrame) -> tuple[OrderedTable, DataFrame]:
    """A mixed batch (seq, op, key columns, value columns) on a multimap, in any order and on the same keys and pairs.

    op is upsert (adds the pair if it isn't there), nodup (as upsert, but KEYEXIST if it is), delete (the pair) or delete_key (the key with all its
    values; its value columns don't count); another op is EINVAL. Whether a pair is there follows from the operation before in the order of pairs, and an ordered lookup of the last
    deletion of its key. A deletion of a key finds something if the pairs added since the last such deletion outnumber those deleted, which is one sum for each
    two deletions. A null in a pair (for delete_key: in a key) makes deletions NOTFOUND, and nothing is added.
    """
    if not table.multi:
        raise status.StoreError(status.INCOMPATIBLE, "use apply_mixed")
    key, pair = list(table.key), list(table.key + table.value)
    batch = batch.select(F.col("seq").cast("bigint").alias("seq"), "op", *pair)
    single = F.col("op").isin(UPSERT, NODUP, DELETE)
    singles, clears = batch.where(single), batch.where(F.col("op") == DELETE_KEY)
    start = F.lit(BEFORE_ALL).cast("bigint")
    size = {"rows_per_bucket": table.rows_per_bucket}

    def cleared_before(rows: DataFrame, like: DataFrame) -> DataFrame:
        order = [(F.col(c), F.col(c)) for c in [*key, "seq"]]
        met = lookup(clears.select("seq", *key), rows, order, F.col("seq"), "_clear", floor=True, strict=True, prefix=len(key), like=like, **size)
        return met.withColumn("_clear", F.coalesce("_clear", start))

    # the operation before in the order of pairs, if it is on the same pair; split points and counts come from the batch itself
    before = table.df.join(singles.select(*pair).distinct(), pair, "left_semi").select(start.alias("seq"), F.lit(None).cast("string").alias("op"), *pair)
    live = F.coalesce(F.col("op") != DELETE, F.lit(True))
    mark = F.struct(*pair, "seq", live.alias("live"))
    met = with_neighbour(before.unionByName(singles), [F.col(c) for c in [*pair, "seq"]], mark, "_met", forward=False, like=singles, **size).where("op is not null")
    met = cleared_before(met, singles)
    same = F.lit(True)
    for c in pair:
        same = same & (F.col(f"_met.{c}") == F.col(c))
    here = F.coalesce(same & F.col("_met.live") & (F.col("_met.seq") >= F.col("_clear")), F.lit(False))
    met = met.withColumn("_here", here)

    # what each deletion of a key finds: the pairs from before the batch, if it is the first, and the sum of changes since the last one
    whole = F.lit(True)
    for c in pair:
        whole = whole & F.col(c).isNotNull()
    change = F.when(whole & (F.col("op") != DELETE) & ~F.col("_here"), 1).when((F.col("op") == DELETE) & F.col("_here"), -1).otherwise(0)
    had = table.df.join(clears.select(*key).distinct(), key, "left_semi").select(*key, start.alias("_clear"), F.lit(1).alias("_change"))
    left = met.select(*key, "_clear", change.alias("_change")).unionByName(had).groupBy(*key, "_clear").agg(F.sum("_change").alias("_left"))
    cleared = cleared_before(clears, clears).join(left, [*key, "_clear"], "left")

    there = F.when(F.col("_here"), status.SUCCESS).otherwise(status.NOTFOUND)
    code = F.when(F.col("op") == UPSERT, status.SUCCESS).when(F.col("op") == NODUP, F.when(F.col("_here"), status.KEYEXIST).otherwise(status.SUCCESS)).otherwise(there)
    said = met.select("seq", *pair, code.alias("code"))
    said = said.unionByName(cleared.select("seq", *pair, F.when(F.col("_left") > 0, status.SUCCESS).otherwise(status.NOTFOUND).alias("code")))
    known = F.coalesce(F.col("op").isin(UPSERT, NODUP, DELETE, DELETE_KEY), F.lit(False))
    said = said.unionByName(batch.where(~known).select("seq", *pair, F.lit(status.EINVAL).alias("code")))

    # afterwards: the last operation on a pair holds, unless its key was deleted later
    last = singles.dropna(subset=pair).groupBy(*pair).agg(F.max_by(F.struct("seq", "op"), "seq").alias("_w"))
    ends = batch.where(single | (F.col("op") == DELETE_KEY)).dropna(subset=key).groupBy(*key).agg(F.max(F.when(F.col("op") == DELETE_KEY, F.col("seq"))).alias("_end"), F.count("*").alias("_ops"))
    new = meet_one(last, ends, key, "_ops").where((F.col("_w.op") != DELETE) & (F.col("_end").isNull() | (F.col("_w.seq") > F.col("_end"))))
    kept = table.df.join(last.select(*pair), pair, "left_anti").join(clears.select(*key).distinct(), key, "left_anti")
    return table._like(kept.unionByName(new.select(*pair))), said
