import pytest
from pyspark.sql import functions as F

from keyloom import status
from keyloom.cli import load_into, main
from keyloom.operators import mutate
from keyloom.operators.table import OrderedTable
from keyloom.sources import dump
from keyloom.sources.store import Store, check_store
from keyloom.status import StoreError

RAW = "key binary, value binary"


def raw(spark, pairs, **modes):
    return OrderedTable(spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], RAW), ["key"], ["value"], **modes)


def got(t):
    return [(bytes(r.key), bytes(r.value)) for r in t.scan().collect()]


def test_a_pinned_reader_sees_its_version_until_it_ends(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with s.transaction() as w:
        w.create("t", RAW, ["key"], ["value"])
        w.put_table("t", raw(spark, [(b"a", b"1")]))
    r = s.read()
    with s.transaction() as w:
        new, said = mutate.put(w.table("t"), raw(spark, [(b"a", b"2"), (b"b", b"3")]).df.withColumn("seq", F.lit(1)), "upsert")
        w.put_table("t", new)
    assert got(r.table("t")) == [(b"a", b"1")]
    assert s.vacuum() == 0 and r.get("t", (b"a",)) == {"value": bytearray(b"1")}
    assert s.readers().first().lag == 1
    r.renew()
    assert got(r.table("t")) == [(b"a", b"2"), (b"b", b"3")]
    assert s.vacuum() == 1
    r.end()
    with pytest.raises(StoreError, match="BAD_TXN"):
        r.table("t")
    assert check_store(s) == []


def test_one_writer_nested_transactions_and_aborts(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    w = s.write()
    with pytest.raises(StoreError, match="BUSY"):
        s.write(wait=False)
    w.create("t", RAW, ["key"], ["value"])
    n = w.nested()
    with pytest.raises(StoreError, match="BAD_TXN"):
        w.names()
    n.put_table("t", raw(spark, [(b"x", b"y")]))
    n.abort()
    assert got(w.table("t")) == []
    with w.nested(read_only=True) as ro, pytest.raises(StoreError, match="EACCESS"):
        ro.put_table("t", raw(spark, []))
    n = w.nested()
    n.put_table("t", raw(spark, [(b"x", b"y")]))
    n.commit()
    assert w.sequence("t", 5) == 0 and w.sequence("t") == 5
    w.canary(1, 2, 3)
    r = w.commit_embark_read()
    assert got(r.table("t")) == [(b"x", b"y")] and s.manifest()["canary"] == [1, 2, 3, 1]
    r.end()
    with s.transaction() as w:
        with pytest.raises(StoreError, match="INCOMPATIBLE"):
            w.create("t", RAW, ["key"], ["value"], value_mode="multi")
        assert w.rename("t", "u") is None and w.names() == ["u"] and not w.drop("t")
        assert w.clear("u")
    with s.read() as r:
        assert got(r.table("u")) == [] and r.sequence("u") == 5


def test_cached_lookups(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with s.transaction() as w:
        w.put_table("t", raw(spark, [(b"a", b"1")]))
        w.put_table("o", raw(spark, [(b"a", b"1")]))
    old = s.read()
    assert s.cache_get(old, "t", (b"a",))[0] == "REFRESHED" and s.cache_get(old, "t", (b"a",))[0] == "HIT"
    with s.transaction() as w:
        w.put_table("o", raw(spark, [(b"a", b"2")]))
        assert s.cache_get(w, "o", (b"a",))[0] == "DIRTY"
    with s.read() as r:
        assert s.cache_get(r, "t", (b"a",)) == ("CONFIRMED", {"value": bytearray(b"1")})
    assert s.cache_get(old, "t", (b"a",))[0] == "BEHIND"
    old.end()


ODD = [(b"", b""), (b" lead", b" x"), (b"back\\slash", bytes(range(256))), (b"new\nline", b"\0"), (b"\xff", b"plain")]


@pytest.mark.parametrize("form", ["bytevalue", "print"])
@pytest.mark.parametrize("concise", [False, True])
def test_dump_and_load_give_the_same_pairs(spark, tmp_path, form, concise):
    pairs = sorted([*ODD, (b"k", b"1"), (b"k", b"2"), (b"k", b" 3")])
    t = raw(spark, pairs, value_mode="multi")
    lines = list(dump.dump_lines(t, "t", form, concise=concise, sequence=7))
    assert lines[0] == "VERSION=3" and lines[-1] == "DATA=END" and "dupsort=1" in lines and "sequence=7" in lines
    (tmp_path / "d.txt").write_text("\n".join(lines) + "\n", encoding="ascii")
    [(s, back)] = dump.load(spark, str(tmp_path / "d.txt"))
    assert (s.name, s.sequence, back.value_mode) == ("t", 7, "multi")
    assert got(back) == pairs


def test_headers_and_malformed_records(spark, tmp_path):
    with pytest.raises(StoreError):
        dump.read_header(["VERSION=2"])
    assert dump.read_header(["VERSION=3", "odd=1"]).warnings == ["unknown keyword odd"]
    (tmp_path / "d.txt").write_text("VERSION=3\nformat=bytevalue\ndatabase=x\ntype=btree\nHEADER=END\n 61\n 6\n 62\n 31\nDATA=END\n")
    with pytest.raises(StoreError, match="EINVAL"):
        dump.load(spark, str(tmp_path / "d.txt"))
    assert got(dump.load(spark, str(tmp_path / "d.txt"), rescue=True)[0][1]) == [(b"b", b"1")]


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    files = [[f"a{i}" for i in range(3)], ["" if i % 5 == 0 else f"b{i}" for i in range(500)], ["c"]]
    for k, lines in enumerate(files):
        (tmp_path / f"part-{k}").write_text("\n".join(lines) + "\n", encoding="ascii")
    want = list(enumerate(x for lines in files for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "512"):  # the largest file is read first, and in the second case in several blocks
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = dump.numbered_lines(spark, str(tmp_path)).collect()
            assert sorted((r.line_no, r.line) for r in rows) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tools(spark, tmp_path, capsys):
    root, text = str(tmp_path / "s"), str(tmp_path / "d.txt")
    s = Store(spark, root)
    with s.transaction() as w:
        w.put_table("t", raw(spark, ODD))
    assert main(["dump", root, "-a", "-f", text], spark) == 0
    assert main(["load", str(tmp_path / "s2"), "-f", text], spark) == 0
    s2 = Store(spark, str(tmp_path / "s2"))
    with s2.read() as r:
        assert got(r.table("t")) == sorted(ODD)
    assert load_into(s2, text, keep=True) == {"t": len(ODD)}
    assert main(["check", root], spark) == 0 and main(["stat", root], spark) == 0 and main(["copy", root, str(tmp_path / "s3"), "-c"], spark) == 0
    assert main(["optimize", root], spark) == 0 and main(["drop", root, "-s", "t", "-d"], spark) == 0 and main(["drop", root, "-s", "t", "-d"], spark) == 2
    assert "entries" in capsys.readouterr().out
    with Store(spark, str(tmp_path / "s3")).read() as r:
        assert got(r.table("t")) == sorted(ODD)


def test_loading_onto_a_multimap(spark, tmp_path):
    more, later = str(tmp_path / "more.txt"), str(tmp_path / "later.txt")
    s = Store(spark, str(tmp_path / "s"))
    with s.transaction() as w:
        w.put_table("t", raw(spark, [(b"b", b"1"), (b"c", b"3")], value_mode="multi"))
    for path, pairs in ((more, [(b"a", b"1"), (b"a", b"2"), (b"b", b"9")]), (later, [(b"c", b"4"), (b"d", b"1")])):
        with open(path, "w", encoding="ascii") as out:
            out.write("\n".join(dump.dump_lines(raw(spark, pairs, value_mode="multi"), "t")) + "\n")
    assert main(["load", str(tmp_path / "s"), "-f", more, "-N"], spark) == 0
    with s.read() as r:
        assert got(r.table("t")) == [(b"a", b"1"), (b"b", b"1"), (b"c", b"3")]
    assert main(["load", str(tmp_path / "s"), "-f", later, "-a"], spark) == 0
    with s.read() as r:
        assert got(r.table("t")) == [(b"a", b"1"), (b"b", b"1"), (b"c", b"3"), (b"c", b"4"), (b"d", b"1")]
    assert main(["load", str(tmp_path / "s"), "-f", more, "-a"], spark) == 2


def test_a_stream_of_changes_is_applied_once(spark, tmp_path):
    from keyloom.streaming import apply_changes

    s = Store(spark, str(tmp_path / "s"))
    with s.transaction() as w:
        w.create("t", "k bigint, v string", ["k"], ["v"])
    rows = [(1, "insert", 1, "a"), (2, "insert", 1, "b"), (3, "upsert", 2, "c"), (4, "delete", 1, None), (5, "update", 2, "d")]
    spark.createDataFrame(rows, "seq bigint, op string, k bigint, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq bigint, op string, k bigint, v string").parquet(str(tmp_path / "in"))
    apply_changes(stream, s, "t", str(tmp_path / "cp")).awaitTermination(120)
    with s.read() as r:
        assert [tuple(x) for x in r.table("t").scan().collect()] == [(2, "d")] and r.sequence("t") == 1
    assert status.SUCCESS in status.MEANING
