"""The text interchange format: a header of name=value lines, then keys and values on lines of their own, per table.

Formats: ``bytevalue`` (hexadecimal) and ``print`` (printable ASCII as it is, other bytes and the backslash as ``\\hh``). Concise dumps leave out the key of
further values of the same key and mark those lines with a second space; therefore a first byte that is a space is always escaped here, which loaders
take as well. Encoding and decoding of records are DataFrame expressions; a dump's lines are written range by range, so files in name order are the dump.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom import status
from keyloom.functions import codecs
from keyloom.operators.table import OrderedTable
from keyloom.plans.ordered import with_position
from keyloom.status import StoreError

STRETCH = 500_000
FLAGS = ("reversekey", "dupsort", "integerkey", "dupfix", "integerdup", "reversedup")
MODES = {"usual": (), "reverse": ("reversekey",), "ordinal": ("integerkey",)}
VALUES = {"single": (), "multi": ("dupsort",), "multi_reverse": ("dupsort", "reversedup"), "multi_samelength": ("dupsort", "dupfix"), "multi_ordinal": ("dupsort", "dupfix", "integerdup"), "multi_reverse_samelength": ("dupsort", "dupfix", "reversedup")}


def escaped(b: Column, form: str) -> Column:
    """The record's text in the given format."""
    h = F.hex(b)
    if form == "bytevalue":
        return F.lower(h)
    pairs = F.regexp_extract_all(h, F.lit("(..)"), 1)

    def one(p: Column, i: Column) -> Column:
        code = F.conv(p, 16, 10).cast("int")
        plain = (code >= 33) & (code <= 126) & (code != 92) | ((code == 32) & (i > 0))
        return F.when(plain, F.chr(code)).otherwise(F.concat(F.lit("\\"), F.lower(p)))

    return F.array_join(F.transform(pairs, one), "")


def unescaped(text: Column, form: str) -> Column:
    """The record's bytes, or null if the text is malformed."""
    if form == "bytevalue":
        return codecs.from_hex(text)
    parts = F.regexp_extract_all(text, F.lit(r"(\\\\|\\[0-9A-Fa-f]{2}|[^\\])"), 1)
    raw = F.array_join(F.transform(parts, lambda p: F.when(p == "\\\\", F.lit("5C")).when(p.startswith("\\"), F.substring(p, 2, 2)).otherwise(F.hex(p.cast("binary")))), "")
    whole = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    return F.when(whole == F.length(text), F.unhex(raw))


def header(table: OrderedTable, name: str | None, form: str, *, sequence: int = 0, canary: list | None = None, page: int = 4096, mapsize: int = 0) -> list[str]:
    out = ["VERSION=3"]
    if mapsize:
        out.append(f"mapsize={mapsize}")
    if canary and canary[3]:
        out.append("canary=v{3},x{0},y{1},z{2}".format(*canary))
    out.append(f"format={form}")
    if name:
        out.append(f"database={name}")
    flags = MODES[table.key_mode] + VALUES[table.value_mode]
    out += ["type=btree", f"db_pagesize={page}", f"duplicates={int(table.multi)}"]
    out += [f"{f}=1" for f in FLAGS if f in flags]
    if sequence:
        out.append(f"sequence={sequence}")
    return [*out, "HEADER=END"]


def records(table: OrderedTable, form: str = "bytevalue", *, concise: bool = False) -> DataFrame:
    """(position, lines) of a raw table: one or two text lines a pair, in order."""
    key, value = (F.col(c).cast("binary") for c in (table.key[0], table.value[0]))
    rows = table.next_dup("_n", forward=False).withColumn("_again", F.col("_n").isNotNull()) if concise and table.multi else table.df.withColumn("_again", F.lit(False))
    placed = OrderedTable(table.df, table.key, table.value, table.key_mode, table.value_mode)
    rows = with_position(rows, placed.order)
    first = F.concat(F.lit(" "), escaped(key, form))
    second = F.concat(F.lit(" "), escaped(value, form))
    return rows.select("position", F.when(F.col("_again"), F.array(F.concat(F.lit(" "), second))).otherwise(F.array(first, second)).alias("lines"))


def dump_lines(table: OrderedTable, name: str | None = None, form: str = "bytevalue", *, concise: bool = False, **head) -> Iterator[str]:
    """A table's dump line by line; rows come from executors partition by partition."""
    yield from header(table, name, form, **head)
    for r in records(table, form, concise=concise).orderBy("position").toLocalIterator():
        yield from r.lines
    yield "DATA=END"


def write_records(table: OrderedTable, path: str, form: str = "bytevalue", *, concise: bool = False) -> None:
    """The record lines as text files, one per range of the order."""
    rows = records(table, form, concise=concise)
    rows.repartitionByRange("position").sortWithinPartitions("position").select(F.explode("lines").alias("value")).write.mode("overwrite").text(path)


@dataclass
class Section:
    """One table of a dump: its header and the record lines' range."""

    name: str | None = None
    form: str = "bytevalue"
    flags: set[str] = field(default_factory=set)
    sequence: int = 0
    canary: tuple | None = None
    warnings: list[str] = field(default_factory=list)
    first: int = 0
    last: int = 0
    rows: DataFrame | None = None  # (seq, key, value): pairs with the number of their line

    @property
    def key_mode(self) -> str:
        return "reverse" if "reversekey" in self.flags else "ordinal" if "integerkey" in self.flags else "usual"

    @property
    def value_mode(self) -> str:
        own = tuple(f for f in ("dupsort", "dupfix", "integerdup", "reversedup") if f in self.flags)
        return next((k for k, v in VALUES.items() if set(v) == set(own)), "multi" if own else "single")


IGNORED = ("mapaddr", "mapsize", "maxreaders", "txnid", "db_pagesize", "geometry", "HEADER")


def read_header(lines: list[str]) -> Section:
    s = Section()
    for line in lines:
        key, _, value = line.partition("=")
        if key == "VERSION":
            if value != "3":
                raise StoreError(status.INCOMPATIBLE, f"dump version {value}")
        elif key == "format":
            if value not in ("print", "bytevalue"):
                raise StoreError(status.EINVAL, f"format {value}")
            s.form = value
        elif key == "database":
            s.name = value
        elif key == "type":
            if value != "btree":
                raise StoreError(status.EINVAL, f"type {value}")
        elif key == "sequence":
            s.sequence = int(value)
        elif key == "canary":
            parts = {p[0]: int(p[1:]) for p in value.split(",")}
            s.canary = (parts.get("x", 0), parts.get("y", 0), parts.get("z", 0))
        elif key in FLAGS or key == "duplicates":
            if value == "1":
                s.flags.add("dupsort" if key == "duplicates" else key)
        elif key not in IGNORED:
            s.warnings.append(f"unknown keyword {key}")
    return s


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no) of a text file or folder of them, by file name and then by place.

    A task reads a block of a file line after line, so a line's number is its place in its block after the lines of all blocks before. What is joined is one row a block, broadcast only where Spark finds it small.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), block.alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_block").agg(F.min("_id").alias("_first"), F.count("line").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    return lines.join(blocks, "_block").select("line", (F.col("_id") + F.col("_base")).alias("line_no"))


def load(spark: SparkSession, path: str, *, rescue: bool = False) -> list[tuple[Section, OrderedTable]]:
    """The tables of a dump. Headers and section marks go through the driver; records are parsed where they are.

    A malformed record is EINVAL, unless ``rescue`` skips it.
    """
    lines = numbered_lines(spark, path).cache()
    marks = [(r.line_no, r.line) for r in lines.where(~F.col("line").startswith(" ") & (F.col("line") != "")).orderBy("line_no").collect()]
    sections, head = [], []
    for no, line in marks:
        if line == "DATA=END":
            if sections:
                sections[-1].last = no
        elif line == "HEADER=END":
            s = read_header(head)
            s.first, head = no + 1, []
            sections.append(s)
        else:
            head.append(line)
    out = []
    for s in sections:
        if not s.last:
            raise StoreError(status.EINVAL, "a table has no DATA=END")
        rows = lines.where((F.col("line_no") >= s.first) & (F.col("line_no") < s.last) & F.col("line").startswith(" "))
        s.rows = parsed(rows, s.form, rescue)
        out.append((s, OrderedTable(s.rows, ["key"], ["value"], s.key_mode, s.value_mode)))
    return out


def parsed(rows: DataFrame, form: str, rescue: bool = False) -> DataFrame:
    """(seq, key, value) from record lines (line_no, line). Concise lines make the role of a line depend on those before: a key line is one whose count of plain lines so far is even."""
    again = F.col("line").startswith("  ")
    # windows run in stretches of lines; what a stretch needs from before it (a count, the last key) is one row a stretch
    inside = Window.partitionBy("_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    told = rows.withColumn("_b", F.floor(F.col("line_no") / STRETCH)).withColumn("_again", again)
    counts = told.groupBy("_b").agg(F.sum((~again).cast("int")).alias("_n"))
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    told = told.join(F.broadcast(counts), "_b").withColumn("_plain", F.sum((~again).cast("int")).over(inside) + F.col("_base"))
    is_key = ~F.col("_again") & (F.col("_plain") % 2 == 1)
    text = F.when(is_key, F.substring("line", 2, 1 << 30))
    carried = told.groupBy("_b").agg(F.max_by(text, F.when(is_key, F.col("line_no"))).alias("_k")).select("_b", F.last("_k", True).over(before).alias("_carry"))
    told = told.join(F.broadcast(carried), "_b").withColumn("_key", F.coalesce(F.last(text, True).over(inside), F.col("_carry")))
    body = F.when(F.col("_again"), F.substring("line", 3, 1 << 30)).otherwise(F.substring("line", 2, 1 << 30))
    pairs = told.where(~is_key).select(F.col("line_no").alias("seq"), unescaped(F.col("_key"), form).alias("key"), unescaped(body, form).alias("value"))
    bad = pairs.where("key is null or value is null")
    if rescue:
        pairs = pairs.dropna()
    elif bad.head(1):
        raise StoreError(status.EINVAL, "a record is malformed")
    return pairs
