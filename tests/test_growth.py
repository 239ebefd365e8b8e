"""Lookups and mixed batches read and shuffle their inputs a fixed number of times, and a row's bucket is found in steps that grow with the logarithm of the buckets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from keyloom import catalog_queries as core
from keyloom.plans import ordered

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_of_many_cuts(spark):
    r = random.Random(2)
    pairs = [(r.choice([None, *range(40)]), r.choice([None, "", *"abcdefgh"])) for _ in range(1500)]
    place = lambda p: tuple((x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate(p))
    cuts = sorted(set(pairs), key=place)[::2][1:]
    assert len(cuts) > 100
    df = spark.createDataFrame(pairs, "a int, b string")
    for at in (True, False):
        rows = ordered.in_buckets(df, [F.col("a"), F.col("b")], cuts, at=at)
        got = [((r.a, r.b), r._b) for r in rows.collect()]
        assert len(got) == len(pairs) and all(b == sum(place(c) <= place(p) if at else place(c) < place(p) for c in cuts) for p, b in got)


def test_a_row_meets_few_cuts(spark):
    """Before, it met the square root of their number, in an expression and in a table."""
    df = spark.range(10_000)
    for n in (100, 3000):
        rows = ordered.in_buckets(df, [F.col("id")], [(i * 3,) for i in range(1, n)])
        text = plan(rows)
        levels = len(re.findall("BroadcastHashJoin|BroadcastNestedLoopJoin", text))
        assert levels <= 4 and len(re.findall(r"id#\d+L[^)]* > \d+", text)) <= 2 * ordered.COARSE and ordered.COARSE <= 8 and ordered.MOST_COARSE <= 8
        assert rows.where("_b <> least(floor(id / 3), %d)" % (n - 1)).count() == 0


@pytest.mark.parametrize("op", ["gt", "le", "ge", "lt"])
def test_probes_are_shuffled_once(spark, op, monkeypatch):
    """One exchange holds rows and probes, another the ends of ranges, the last the list of ranges; probes are neither counted by key nor joined with their answers."""
    monkeypatch.setattr(ordered, "FEW_PROBES", 1)
    assert plan(core.QUERIES[f"whole_pair_{op}"](spark, SF, rows_per_bucket=50)).count("hashpartitioning") <= 3


def test_mixed_batches_are_shuffled_few_times(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW_PROBES", 1)
    text = plan(core.QUERIES["multi_mixed_status"](spark, SF))
    assert text.count("Exchange ") <= 20 and text.count("FileScan") <= 30


@pytest.mark.parametrize("floor", [True, False])
def test_hot_probes_equal_others(spark, floor, monkeypatch):
    """A probe key with more rows than a bucket takes the way that looks it up once; nulls find nothing on either."""
    monkeypatch.setattr(ordered, "FEW_PROBES", 1)
    data = spark.createDataFrame([(i * 2,) for i in range(500)], "k bigint")
    asked = [(i, i % 900) for i in range(1500)] + [(i, 77) for i in range(2000, 6000)] + [(7000, None)]
    order, how = [(F.col("k"), F.col("p"))], {"floor": floor, "strict": True, "rows_per_bucket": 200}
    for some in (asked, asked[:1500] + asked[-1:]):
        found = ordered.lookup(data, spark.createDataFrame(some, "i bigint, p bigint"), order, F.col("k"), "k", **how)
        assert found.columns == ["i", "p", "k"]
        best = lambda p: None if p is None else ((p - 1) // 2 * 2 if p > 0 else None) if floor else (p // 2 * 2 + 2)
        assert {(r.i, r.p, r.k) for r in found.collect()} == {(i, p, best(p)) for i, p in some} and found.count() == len(some)
