"""Command line: ``python -m keyloom {check,copy,optimize,drop,dump,load,stat} STORE ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keyloom import status
from keyloom.operators import check, mutate
from keyloom.operators.table import OrderedTable
from keyloom.sources import dump
from keyloom.sources.store import Store, check_store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("check", "verify tables"), ("copy", "copy the current version"), ("optimize", "sort and merge files"), ("drop", "empty or delete a table"), ("dump", "write tables as text"), ("load", "read tables from text"), ("stat", "show counts")):
        s = sub.add_parser(name, help=about)
        s.add_argument("store")
        if name == "copy":
            s.add_argument("to")
            s.add_argument("-c", "--compact", action="store_true")
        if name in ("optimize", "drop", "dump", "stat"):
            s.add_argument("-s", "--table")
        if name == "drop":
            s.add_argument("-d", "--delete", action="store_true", help="delete the table, not only its pairs")
        if name == "dump":
            s.add_argument("-a", "--all", action="store_true")
            s.add_argument("-l", "--list", action="store_true")
            s.add_argument("-p", "--print", action="store_true", dest="printable")
            s.add_argument("-c", "--concise", action="store_true")
            s.add_argument("-f", "--file")
        if name == "load":
            s.add_argument("-f", "--file", required=True)
            s.add_argument("-s", "--table")
            s.add_argument("-N", "--keep", action="store_true", help="keep what is present: only pairs of absent keys are added")
            s.add_argument("-a", "--append", action="store_true", help="records are in order and come after all that is there")
            s.add_argument("-p", "--purge", action="store_true", help="empty tables first")
            s.add_argument("-r", "--rescue", action="store_true", help="skip malformed records")
            s.add_argument("-T", "--text", action="store_true", help="lines of keys and values without a header")
    return p


def raw(t: OrderedTable) -> OrderedTable:
    """The table with one binary key and value: single columns as their bytes, several or numbers as JSON text."""

    def one(cols: list[str]):
        kind = t.df.schema[cols[0]].dataType.typeName() if len(cols) == 1 else ""
        return F.col(cols[0]).cast("binary") if kind in ("binary", "string") else F.to_json(F.struct(*cols)).cast("binary")

    return OrderedTable(t.df.select(one(t.key).alias("key"), one(t.value).alias("value") if t.value else F.lit(b"").alias("value")), ["key"], ["value"], t.key_mode, t.value_mode)


def load_into(store: Store, path: str, *, table: str | None = None, keep=False, purge=False, rescue=False, append=False) -> dict[str, int]:
    """Loads a dump's tables; rows by table. A present sequence above the dump's is RESULT_TRUE. With ``keep`` only pairs of absent keys are added, on multimaps
    the first of each; with ``append`` records that aren't in order after all present ones are EKEYMISMATCH."""
    done = {}
    for s, t in dump.load(store.spark, path, rescue=rescue):
        name = table or s.name or "main"
        with store.transaction() as w:
            old = w.create(name, "key binary, value binary", ["key"], ["value"], key_mode=t.key_mode, value_mode=t.value_mode)
            now = w.sequence(name)
            if now > s.sequence:
                raise status.StoreError(status.RESULT_TRUE, f"{name}: its sequence {now} is above the dump's")
            batch = s.rows  # a line's number is the same however often the rows are made
            if purge:
                old = old._like(old.df.limit(0))
            put = mutate.put_multi if t.multi else mutate.put
            new = mutate.append(old, batch) if append else put(old, batch, mutate.INSERT if keep else mutate.UPSERT)[0]
            w.put_table(name, new, sequence=s.sequence)
            if s.canary:
                w.canary(*s.canary)
        done[name] = t.df.count()
    return done


def load_plain(store: Store, path: str, table: str) -> int:
    """Text without a header: keys and values on alternate lines, escaped as in printable dumps."""
    lines = dump.numbered_lines(store.spark, path)
    rows = lines.groupBy(F.floor(F.col("line_no") / 2).alias("seq")).agg(F.min_by("line", "line_no").alias("k"), F.max_by("line", "line_no").alias("v"))
    rows = rows.select("seq", dump.unescaped(F.col("k"), "print").alias("key"), dump.unescaped(F.col("v"), "print").alias("value"))
    with store.transaction() as w:
        old = w.create(table, "key binary, value binary", ["key"], ["value"])
        w.put_table(table, mutate.put(old, rows, "upsert")[0])
    return rows.count()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("keyloom").getOrCreate()
    try:
        store = Store(spark, a.store, create=a.command == "load")
        if a.command == "check":
            problems = check_store(store)
            for name, what in problems:
                print(f"{name}: {what}")
            print(f"{len(problems)} problems")
            return 1 if problems else 0
        if a.command == "copy":
            store.copy(a.to, compact=a.compact)
        elif a.command == "optimize":
            for name in [a.table] if a.table else [r.name for r in store.tables().collect()]:
                store.optimize(name)
            store.vacuum()
        elif a.command == "drop":
            with store.transaction() as w:
                (w.drop if a.delete else w.clear)(a.table, throw_if_absent=True)
        elif a.command == "dump":
            with store.read() as r:
                names = [n for n in r.names() if "\0" not in n] if a.all or a.list else [a.table]
                if a.list:
                    print("\n".join(names))
                    return 0
                out = open(a.file, "w", encoding="ascii") if a.file else sys.stdout  # noqa: SIM115
                for name in names:
                    for line in dump.dump_lines(raw(r.table(name)), name, "print" if a.printable else "bytevalue", concise=a.concise, sequence=r.sequence(name), canary=r.manifest["canary"]):
                        print(line, file=out)
                if a.file:
                    out.close()
        elif a.command == "load":
            if a.text:
                print(a.table or "main", load_plain(store, a.file, a.table or "main"))
            else:
                for name, n in load_into(store, a.file, table=a.table, keep=a.keep, purge=a.purge, rescue=a.rescue, append=a.append).items():
                    print(name, n)
        elif a.command == "stat":
            print(store.info())
            with store.read() as r:
                for name in [a.table] if a.table else r.names():
                    print(name, check.stat(r.table(name)).first().asDict())
    except status.StoreError as e:
        print(e, file=sys.stderr)
        return 2
    return 0
