"""Exchanged pairs where the new pair is there already: the query keeps every row, as its SQL does; a map of distinct pairs says KEYEXIST."""

from collections import Counter

import duckdb

from keyloom import catalog_queries as core
from keyloom.operators import mutate
from keyloom.operators.table import OrderedTable


def test_replace_multi_where_shifted_events_are_there(spark, tmp_path):
    rows = [(u, e) for u in (1, 2) for e in (3, 4, 6, 9, 9, 15)] + [(1, 1000003), (1, 1000009), (2, 1000015), (2, 1000015), (3, 1000003)]
    spark.createDataFrame(rows, "user_id bigint, event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got = Counter(map(tuple, core.QUERIES["replace_multi"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == Counter(con.execute(core.ORACLE["replace_multi"]).fetchall()) and sum(got.values()) == len(rows)


def test_exchanges_in_distinct_and_repeated_pairs(spark):
    t = OrderedTable(spark.createDataFrame([(1, 10), (1, 10), (1, 20), (2, None)], "k bigint, v bigint"), ["k"], ["v"], value_mode="multi")
    batch = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 10, 30), (3, 9, 10, 30), (4, 1, 20, None)], "seq bigint, k bigint, old_v bigint, v bigint")
    new, said = mutate.replace_value(t, batch, repeats=True)
    assert Counter(map(tuple, new.df.collect())) == Counter([(1, 20), (1, 20), (1, None), (2, None)])
    assert {r.seq: r.code for r in said.collect()} == {1: "SUCCESS", 2: "NOTFOUND", 3: "NOTFOUND", 4: "SUCCESS"} and said.count() == 4
    once = t._like(t.df.distinct())
    new, said = mutate.replace_value(once, batch)
    assert {r.seq: r.code for r in said.collect()}[1] == "KEYEXIST"
