import bisect
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import codecs as C
from keyloom.operators import check, mutate
from keyloom.operators.table import OrderedTable
from keyloom.plans import ordered
from keyloom.status import StoreError


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    pairs = sorted({(rnd.randrange(200), rnd.randrange(30)) for _ in range(3000)})
    return pairs, OrderedTable(spark.createDataFrame(pairs, "k bigint, v bigint"), ["k"], ["v"], value_mode="multi", rows_per_bucket=150)


OPS = {"lt": lambda xs, p: bisect.bisect_left(xs, p) - 1, "le": lambda xs, p: bisect.bisect_right(xs, p) - 1, "ge": bisect.bisect_left, "gt": bisect.bisect_right}


@pytest.mark.parametrize("op", OPS)
def test_nearest_in_many_buckets_equals_bisection(spark, data, op):
    pairs, t = data
    rnd = random.Random(6)
    asked = [(i, rnd.randrange(-3, 205), rnd.randrange(-2, 33)) for i in range(2000)] + [(i, 77, 7) for i in range(2000, 2600)]
    probes = spark.createDataFrame([*asked, (9999, None, 1)], "i bigint, pk bigint, pv bigint")
    found = {r.i: r.found for r in t.nearest(probes, ["pk"], op, ["pv"]).collect()}
    inside = {r.i: r.found for r in t.nearest(probes, ["pk"], op, ["pv"], within=True).collect()}
    assert len(found) == len(asked) + 1 and found[9999] is None
    for i, k, v in asked:
        at = OPS[op](pairs, (k, v))
        hit = pairs[at] if 0 <= at < len(pairs) else None
        assert (found[i] and tuple(found[i])) == hit
        assert (inside[i] and tuple(inside[i])) == (hit if hit and hit[0] == k else None)


def test_positions_and_neighbours_over_buckets(data):
    pairs, t = data
    assert [(r.k, r.v) for r in t.positions().orderBy("position").collect()] == pairs
    nxt = {(r.k, r.v): r.n and tuple(r.n) for r in t.next("n").collect()}
    prv = {(r.k, r.v): r.n and tuple(r.n) for r in t.previous("n").collect()}
    for i, p in enumerate(pairs):
        assert nxt[p] == (pairs[i + 1] if i + 1 < len(pairs) else None)
        assert prv[p] == (pairs[i - 1] if i else None)
    assert len(ordered.split_points(t.df, t.order, 150)) > 10


def test_two_level_buckets(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    cuts = ordered.split_points(df, [F.col("x")], 50)
    assert len(cuts) > 2 * ordered.COARSE
    got = df.select("x", ordered.bucket(df, [F.col("x")], cuts).alias("b")).collect()
    flat = [c[0] for c in cuts]
    assert all(r.b == bisect.bisect_right(flat, r.x) for r in got)


@pytest.mark.parametrize("op", OPS)
def test_few_probes_equal_many(spark, data, op, monkeypatch):
    """Without a shuffle of the table, and with one, and in buckets from a table."""
    pairs, t = data
    asked = [(i, k, v) for i, (k, v) in enumerate([(-1, 0), (0, 0), (77, 7), (77, 7), (500, 1), *pairs[::150], *((k, 99) for k in range(0, 199, 40))])]
    probes = spark.createDataFrame([*asked, (999, None, 1)], "i bigint, pk int, pv bigint")
    few = t.nearest(probes, ["pk"], op, ["pv"])
    assert "rangepartitioning" not in few._jdf.queryExecution().toString()
    rows = {r.i: r.found and tuple(r.found) for r in few.collect()}
    within = {r.i: r.found and tuple(r.found) for r in t.nearest(probes, ["pk"], op, ["pv"], within=True).collect()}
    for i, k, v in asked:
        at = OPS[op](pairs, (k, v))
        hit = pairs[at] if 0 <= at < len(pairs) else None
        assert rows[i] == hit and within[i] == (hit if hit and hit[0] == k else None)
    assert rows[999] is None
    monkeypatch.setattr(ordered, "FEW_PROBES", 1)
    monkeypatch.setattr(ordered, "MOST_COARSE", 2)
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 1)
    assert {r.i: r.found and tuple(r.found) for r in t.nearest(probes, ["pk"], op, ["pv"]).collect()} == rows


def test_probes_of_another_type(spark):
    t = OrderedTable(spark.range(10).select(F.col("id").alias("k")), ["k"])
    probes = spark.createDataFrame([(2.5,), (9.5,), (-0.5,)], "p double")
    assert {(r.p, r.found and r.found.k) for r in t.nearest(probes, ["p"], "ge").collect()} == {(2.5, 3), (9.5, None), (-0.5, 0)}


def test_buckets_from_a_table(data, monkeypatch):
    pairs, t = data
    monkeypatch.setattr(ordered, "COARSE", 2)
    monkeypatch.setattr(ordered, "MOST_COARSE", 3)
    assert [(r.k, r.v) for r in t.positions().orderBy("position").collect()] == pairs
    assert [tuple(t.scroll(n).first()) for n in (0, 1, 700, len(pairs) - 1)] == [(*pairs[n], n) for n in (0, 1, 700, len(pairs) - 1)]
    assert t.scroll(len(pairs)).count() == 0 and [(r.slot, r.position) for r in t.distribute(5).orderBy("slot").collect()] == [(i, i * len(pairs) // 5) for i in range(5)]


def test_estimates_keep_their_error(spark):
    t = OrderedTable(spark.range(200_000).select((F.col("id") * F.col("id") % 100_003).alias("k")), ["k"])
    ranges = [((a,), (a + 20_000,)) for a in range(0, 80_000, 10_000)] + [(None, (50_000,)), ((50_000,), None), (None, None)]
    exact = [t.df.where(f"k >= {(a or (0,))[0]} and k < {(b or (10**9,))[0]}").count() for a, b in ranges]
    error = 200_000 / (2 * 10_000**0.5)
    assert all(abs(x - e) <= 4 * error for x, e in zip(exact, t.estimates(ranges), strict=True))
    assert OrderedTable(spark.range(0).toDF("k"), ["k"]).estimate(None, (3,)) == 0


def test_a_hot_key_of_a_batch_is_cut(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 7)
    t = OrderedTable(spark.createDataFrame([(1, 10), (2, 20)], "k bigint, v bigint"), ["k"], ["v"])
    batch = spark.createDataFrame([(i, 1 if i % 3 else 5, i) for i in range(200)] + [(300, None, 1)], "seq bigint, k bigint, v bigint").repartition(4)
    new, said = mutate.put(t, batch, "insert")
    assert sorted(map(tuple, new.df.collect())) == [(1, 10), (2, 20), (5, 0)]
    assert said.count() == 201 and said.where("code = 'SUCCESS'").select("seq").collect()[0][0] == 0
    new, _ = mutate.put(t, batch, "upsert")
    assert sorted(map(tuple, new.df.collect())) == [(1, 199), (2, 20), (5, 198)]


def test_empty_tables_and_null_keys(spark):
    t = OrderedTable(spark.createDataFrame([(None, 1)], "k bigint, v bigint"), ["k"], ["v"])
    probes = spark.createDataFrame([(5,)], "p bigint")
    assert t.first().count() == t.last().count() == t.scroll(0).count() == t.distribute(3).count() == 0
    assert t.nearest(probes, ["p"], "ge").first().found is None and t.get(probes, ["p"], count=True).first()["values"] == 0
    assert t.lower_bound(probes, ["p"]).first().status == "NOTFOUND"
    with pytest.raises(StoreError):
        t.delete_range((5,), (1,))
    with pytest.raises(StoreError):
        t.distance(None, None)


def test_raw_byte_order_and_reverse_mode(spark):
    keys = [b"", b"\x00", b"\x00\x00", b"\x7f", b"\x7f\x00", b"\x80", b"\xff", *(bytes([i]) for i in range(1, 127)), b"\x00\x00\x03\xe8"]
    df = spark.createDataFrame([(bytearray(k), 1) for k in keys], "k binary, v int")
    assert [bytes(r.k) for r in OrderedTable(df, ["k"], ["v"]).scan().collect()] == sorted(keys)
    back = OrderedTable(df, ["k"], ["v"], key_mode="reverse")
    assert [bytes(r.k) for r in back.scan().collect()] == sorted(keys, key=lambda k: k[::-1])


def model(now, ops):
    now, said = dict(now), {}
    for seq, op, k, v in ops:
        if op == "insert" and k in now:
            said[seq] = "KEYEXIST"
        elif op in ("update", "delete") and k not in now:
            said[seq] = "NOTFOUND"
        else:
            said[seq] = "SUCCESS"
            if op == "delete":
                del now[k]
            else:
                now[k] = v
    return now, said


def test_mixed_batches_equal_one_operation_after_the_other(spark):
    rnd = random.Random(1)
    start = {k: k * 10 for k in range(0, 60, 2)}
    ops = [(i, rnd.choice(["upsert", "insert", "update", "delete"]), rnd.randrange(70), rnd.randrange(1000)) for i in range(800)]
    t = OrderedTable(spark.createDataFrame(list(start.items()), "k bigint, v bigint"), ["k"], ["v"])
    batch = spark.createDataFrame(ops, "seq bigint, op string, k bigint, v bigint")
    new, said = mutate.apply_mixed(t, batch)
    now, codes = model(start, ops)
    assert {r.k: r.v for r in new.df.collect()} == now
    assert {r.seq: r.code for r in said.collect()} == codes
    for kind in ("upsert", "insert", "update"):
        own = [(s, kind, k, v) for s, _, k, v in ops]
        new, said = mutate.put(t, spark.createDataFrame(own, "seq bigint, op string, k bigint, v bigint").drop("op"), kind)
        now, codes = model(start, own)
        assert {r.k: r.v for r in new.df.collect()} == now and {r.seq: r.code for r in said.collect()} == codes


def test_multimap_mutations(spark):
    t = OrderedTable(spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "k bigint, v bigint"), ["k"], ["v"], value_mode="multi")
    b = spark.createDataFrame([(1, 1, 2), (2, 2, 6), (3, 3, 7), (4, 3, 8)], "seq bigint, k bigint, v bigint")
    pairs = lambda x: sorted(map(tuple, x.df.collect()))
    code = lambda x: {r.seq: r.code for r in x.collect()}
    assert pairs(mutate.put_multi(t, b, "upsert")[0]) == [(1, 1), (1, 2), (2, 5), (2, 6), (3, 7), (3, 8)]
    assert code(mutate.put_multi(t, b, "nodup")[1]) == {1: "KEYEXIST", 2: "SUCCESS", 3: "SUCCESS", 4: "SUCCESS"}
    assert code(mutate.put_multi(t, b, "insert")[1]) == {1: "KEYEXIST", 2: "KEYEXIST", 3: "SUCCESS", 4: "KEYEXIST"}
    new, said = mutate.put_multi(t, b, "update")
    assert code(said) == {1: "EMULTIVAL", 2: "SUCCESS", 3: "NOTFOUND", 4: "NOTFOUND"} and pairs(new) == [(1, 1), (1, 2), (2, 6)]
    with pytest.raises(StoreError, match="EKEYMISMATCH"):
        mutate.append(t, spark.createDataFrame([(1, 0, 0)], "seq bigint, k bigint, v bigint"))
    assert check.duplicates(t.df, ["k"]).count() == 1


def test_codecs_round_trip_all_bytes(spark):
    raw = [b"", b"\0", b"\0\0a", bytes(range(256)), b"plain", b"\xed\xa0\x80", b"x" * 200]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    out = df.select("i", "b", C.from_hex(C.to_hex(F.col("b"))).alias("h"), C.from_base64(C.to_base64(F.col("b"))).alias("s"), C.from_base58(C.to_base58(F.col("b"))).alias("f"), C.reverse_bytes(F.col("b")).alias("r"), C.is_printable(F.col("b")).alias("p")).collect()
    for r in out:
        assert r.h == r.s == r.f == r.b and bytes(r.r) == bytes(r.b)[::-1]
    assert [r.p for r in sorted(out, key=lambda r: r.i)] == [False, False, False, False, True, False, True]
    bad = spark.createDataFrame([("ABC",), ("zz",), ("!!!",), ("0O",)], "t string")
    assert [tuple(r) for r in bad.select(C.from_hex(F.col("t")), C.from_base64(F.col("t")), C.is_hex(F.col("t"))).collect()] == [(None, None, False)] * 4
    assert bad.select(C.from_base58(F.col("t")).alias("x")).collect()[3].x is None


def test_number_keys_keep_the_order(spark):
    xs = [float("-inf"), -1.5, -5e-324, -0.0, 0.0, 5e-324, 0.1, 1.0, float(2**53 - 1), float("inf")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", "x", C.key_from_double(F.col("x")).alias("k"))
    rows = df.select("i", "k", C.double_from_key(F.col("k")).alias("y")).collect()
    assert [r.i for r in sorted(rows, key=lambda r: bytes(r.k))] == list(range(len(xs))) and [r.y for r in rows] == xs
    ns = [-(2**63), -1, 0, 1, 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", C.key_from_i64(F.col("n")).alias("k"), C.i64_from_key(C.key_from_i64(F.col("n"))).alias("m"), C.int_of(C.little_endian(F.col("n"), 8), 8).alias("j")).collect()
    assert [r.n for r in sorted(rows, key=lambda r: bytes(r.k))] == ns and all(r.n == r.m == r.j for r in rows)


def test_a_key_with_most_operations(spark):
    """Half of all operations are on one key; ranges of its operations are folded apart."""
    rnd = random.Random(3)
    start = {k: 0 for k in range(5)}
    ops = [(i, rnd.choice(["upsert", "insert", "update", "delete", "what"]), 7 if rnd.random() < 0.5 else rnd.randrange(10), i) for i in range(2000)]
    t = OrderedTable(spark.createDataFrame(list(start.items()), "k bigint, v bigint"), ["k"], ["v"], rows_per_bucket=100)
    new, said = mutate.apply_mixed(t, spark.createDataFrame([*ops, (5000, "upsert", None, 1)], "seq bigint, op string, k bigint, v bigint"))
    now, codes = model(start, [o for o in ops if o[1] != "what"])
    got = {r.seq: r.code for r in said.collect()}
    assert {r.k: r.v for r in new.df.collect()} == now
    assert {s: got[s] for s in codes} == codes and {got[o[0]] for o in ops if o[1] == "what"} == {"EINVAL"} and len(got) == 2001


def multi_model(start, ops):
    now, codes = set(start), {}
    for seq, op, k, v in ops:
        if op == "delete_key":
            mine = {p for p in now if p[0] == k}
            codes[seq] = "SUCCESS" if mine else "NOTFOUND"
            now -= mine
        elif op == "delete":
            codes[seq] = "SUCCESS" if (k, v) in now else "NOTFOUND"
            now.discard((k, v))
        elif op in ("upsert", "nodup"):
            codes[seq] = "KEYEXIST" if op == "nodup" and (k, v) in now else "SUCCESS"
            now.add((k, v))
        else:
            codes[seq] = "EINVAL"
    return now, codes


def test_mixed_batches_of_multimaps_equal_one_operation_after_the_other(spark):
    rnd = random.Random(3)
    start = sorted({(rnd.randrange(12), rnd.randrange(6)) for _ in range(30)})
    kinds = ["upsert", "nodup", "delete", "delete", "delete_key", "what"]
    ops = [(i, rnd.choice(kinds), 7 if rnd.random() < 0.4 else rnd.randrange(16), rnd.randrange(6)) for i in range(1500)]
    ops = [(i, op, k, None if op == "delete_key" else v) for i, op, k, v in ops]
    t = OrderedTable(spark.createDataFrame(start, "k bigint, v bigint"), ["k"], ["v"], value_mode="multi", rows_per_bucket=200)
    nulls = [(5000, "delete_key", None, None), (5001, "delete", 7, None), (5002, "upsert", None, 1)]
    new, said = mutate.apply_mixed_multi(t, spark.createDataFrame([*ops, *nulls], "seq bigint, op string, k bigint, v bigint"))
    now, codes = multi_model(start, ops)
    assert sorted(map(tuple, new.df.collect())) == sorted(now)
    got = {r.seq: r.code for r in said.collect()}
    assert got == codes | {5000: "NOTFOUND", 5001: "NOTFOUND", 5002: "SUCCESS"}
    none = spark.createDataFrame([], "seq bigint, op string, k bigint, v bigint")
    same, said = mutate.apply_mixed_multi(t, none)
    assert sorted(map(tuple, same.df.collect())) == start and said.collect() == []


def test_empty_batches_and_tables(spark):
    t = OrderedTable(spark.createDataFrame([(1, 2)], "k bigint, v bigint"), ["k"], ["v"])
    none = spark.createDataFrame([], "seq bigint, op string, k bigint, v bigint")
    for out in (mutate.apply_mixed(t, none), mutate.put(t, none.drop("op"), "upsert"), mutate.put(t, none.drop("op"), "insert"), mutate.delete(t, none)):
        assert [tuple(r) for r in out[0].df.collect()] == [(1, 2)] and out[1].collect() == []
    batch = spark.createDataFrame([(1, "upsert", 4, 5), (2, "delete", 4, None), (3, "insert", 4, 6)], "seq bigint, op string, k bigint, v bigint")
    new, said = mutate.apply_mixed(t._like(t.df.limit(0)), batch)
    assert [tuple(r) for r in new.df.collect()] == [(4, 6)] and {r.code for r in said.collect()} == {"SUCCESS"}
