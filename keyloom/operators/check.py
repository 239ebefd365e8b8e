"""Integrity checks and size statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import modes
from keyloom.operators.table import OrderedTable
from keyloom.plans import ordered


def order_violations(df: DataFrame, order: list[Column], place: str, *, strict: bool = True, rows_per_bucket: int = ordered.ROWS_PER_BUCKET) -> DataFrame:
    """Rows that, in the order of column ``place``, come before (or, ``strict``, at) their predecessor's key."""
    key = ordered.key_struct(order)
    told = ordered.with_neighbour(df, [F.col(place)], key, "_prev", forward=False, rows_per_bucket=rows_per_bucket)
    return told.where(F.col("_prev") >= key if strict else F.col("_prev") > key).drop("_prev")


def duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys (or pairs) that occur more than once, with ``rows``."""
    return df.groupBy(*cols).agg(F.count("*").alias("rows")).where("rows > 1")


def wrong_sizes(table: OrderedTable) -> DataFrame:
    """Raw rows (binary key and value) whose sizes the modes forbid; values of same-length modes are held against the commonest length."""
    key, value = F.col(table.key[0]), F.col(table.value[0])
    bad = modes.size_problem(key, table.key_mode, modes.MOST_KEY_BYTES) | modes.size_problem(value, table.value_mode, modes.MOST_KEY_BYTES if table.multi else modes.MOST_VALUE_BYTES)
    if modes.is_same_length(table.value_mode):
        common = table.df.groupBy(F.octet_length(value).alias("_n")).count().orderBy(F.desc("count"), "_n").limit(1).select("_n")
        return table.df.join(F.broadcast(common), F.lit(True)).where(bad | (F.octet_length(value) != F.col("_n"))).drop("_n")
    return table.df.where(bad)


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    """(bucket, rows, total): lengths by power of two; bucket is the least length of its range (0, 1, 2, 4, ...)."""
    n = length.cast("bigint")
    low = F.when(n <= 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.length(F.bin(n)) - 1).cast("int")))
    return df.groupBy(low.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(n).alias("total"))


def value_histogram(table: OrderedTable) -> DataFrame:
    """(bucket, rows, total) of how many values keys have: keys by power of two, and their values."""
    per_key = table.df.groupBy(*table.key).agg(F.count("*").alias("_n"))
    return length_histogram(per_key, F.col("_n"))


def stat(table: OrderedTable) -> DataFrame:
    """One row: entries and keys."""
    if not table.multi:
        return table.df.agg(F.count("*").alias("entries"), F.count("*").alias("keys"))
    return table.df.groupBy(*table.key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("entries"), F.count("*").alias("keys"))


def handle_pairs(table: OrderedTable, handler, schema: str) -> DataFrame:
    """Every pair through a Python callable over pandas batches (a user's own check); nothing of it is pushed down."""
    return table.df.mapInPandas(handler, schema)
