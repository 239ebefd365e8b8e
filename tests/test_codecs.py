"""Codecs, byte slices, ordered keys and size checks on edge values, against plain Python."""

import base64
import math
import struct

from pyspark.sql import functions as F

from keyloom.functions import codecs as C
from keyloom.operators import check
from keyloom.operators.table import OrderedTable

BYTES = [b"", b"\0", b"\0\0\1", b"aBad1dea", b" x", b"a\\b\n", bytes(range(256)), b"\xff" * 77, "é語👍".encode(), b"\xed\xa0\x80", "語".encode()[:2], b"~", b"\x7f", b"a\tb"]


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_base58(raw: bytes) -> str:
    alphabet, n, out = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", int.from_bytes(raw, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = alphabet[k] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def test_text_codecs(spark):
    raw = [bytearray(b) for b in BYTES]
    assert column(spark, raw, "binary", C.to_hex) == [b.hex() for b in BYTES]
    assert column(spark, raw, "binary", C.to_base58) == [plain_base58(b) for b in BYTES]
    assert column(spark, raw, "binary", C.to_base64) == [base64.b64encode(b).decode() for b in BYTES]
    for there, back in ((C.to_hex, C.from_hex), (C.to_base58, C.from_base58), (C.to_base64, C.from_base64)):
        got = column(spark, raw, "binary", lambda x, there=there, back=back: back(there(x)))
        assert [bytes(g) for g, b in zip(got, BYTES, strict=True) if b] == [b for b in BYTES if b]
    lines = column(spark, raw, "binary", lambda x: C.to_base64(x, wrap=76))
    assert all(len(line) <= 76 for t in lines for line in t.split("\n")) and [t.replace("\n", "") for t in lines] == [base64.b64encode(b).decode() for b in BYTES]
    # the value of the first of a thousand one-row transactions: base58 of four zero bytes
    assert column(spark, [bytearray(4)], "binary", C.to_base58) == ["1111"]


def test_invalid_text(spark):
    texts = ["0g", "abc", "a b", "ab", "AB", "", None, "0OIl", "a=bc", "YQ==", "YQ=", "YWI=", "Y Q = ="]
    assert column(spark, texts, "string", C.is_hex) == [False, False, False, True, True, False, None, False, False, False, False, False, False]
    assert column(spark, ["ab cd"], "string", lambda x: C.is_hex(x, ignore_spaces=True)) == [True]
    assert column(spark, ["0", "O", "I", "l", "11", "z"], "string", C.is_base58) == [False, False, False, False, True, True]
    assert column(spark, ["0", "l1"], "string", C.from_base58) == [None, None]
    assert column(spark, ["YQ==", "YQ=", "YWI=", "a=bc", "Y Q=="], "string", C.is_base64) == [True, False, True, False, False]
    assert column(spark, ["Y Q=="], "string", lambda x: C.is_base64(x, ignore_spaces=True)) == [True]


def test_printable_and_debug_text(spark):
    raw = [bytearray(b) for b in BYTES]
    printable = column(spark, raw, "binary", C.is_printable)

    def plain(b):
        try:
            return bool(b) and all(c >= " " and not "\x7f" <= c <= "\x9f" for c in b.decode())
        except UnicodeDecodeError:
            return False

    assert printable == [plain(b) for b in BYTES]
    assert column(spark, raw, "binary", C.debug_text) == [f"'{b.decode()}'" if plain(b) else b.hex() for b in BYTES]


def test_integers_of_bytes(spark):
    numbers = [0, 1, 255, 256, 65535, 2**31, 2**32 - 1, 2**63 - 1]
    for size in (1, 2, 4, 8):
        some = [n for n in numbers if n < 1 << (8 * size)]
        assert [bytes(x) for x in column(spark, some, "bigint", lambda n, size=size: C.big_endian(n, size))] == [n.to_bytes(size, "big") for n in some]
        assert [bytes(x) for x in column(spark, some, "bigint", lambda n, size=size: C.little_endian(n, size))] == [n.to_bytes(size, "little") for n in some]
        raw = [bytearray((n % (1 << (8 * size))).to_bytes(size, "little")) for n in (*some, 2 ** (8 * size) - 1, 2 ** (8 * size - 1))]
        assert [int(x) for x in column(spark, raw, "binary", lambda b, size=size: C.uint_of(b, size))] == [int.from_bytes(b, "little") for b in raw]
        assert column(spark, raw, "binary", lambda b, size=size: C.int_of(b, size)) == [int.from_bytes(b, "little", signed=True) for b in raw]
    raw = [bytearray(n) for n in (0, 1, 2, 3, 4, 5, 8, 9)]
    assert [x is not None for x in column(spark, raw, "binary", lambda b: C.uint_of(b, 4, adapt=True))] == [False, True, True, False, True, False, False, False]
    assert [x is not None for x in column(spark, raw, "binary", lambda b: C.uint_of(b, 4))] == [False, False, False, False, True, False, False, False]


def test_double_keys_sort_like_numbers(spark):
    values = [-math.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 0.1, 1.0, float(2**53 - 1), math.inf, math.nan]
    keys = [bytes(k) for k in column(spark, values, "double", C.key_from_double)]
    assert keys == sorted(keys)
    bits = [struct.unpack(">Q", struct.pack(">d", v))[0] for v in values]
    assert keys[:-1] == [((b ^ (2**64 - 1)) if b >> 63 else b | 1 << 63).to_bytes(8, "big") for b in bits[:-1]]
    back = column(spark, [*map(bytearray, keys), bytearray(3), None], "binary", C.double_from_key)
    assert back[:-3] == values[:-1] and math.isnan(back[-3]) and back[-2:] == [None, None]
    assert column(spark, [None, 1.5], "double", C.key_from_double)[0] is None
    whole = [-(2**53) + 1, -1, 0, 1, 2**53 - 1, 2**53]
    assert [k and bytes(k) for k in column(spark, whole, "bigint", C.key_from_json_integer)] == [*(bytes(k) for k in column(spark, list(map(float, whole[:-1])), "double", C.key_from_double)), None]


def test_size_checks_and_handlers(spark):
    rows = [(bytearray(8), bytearray(8)), (bytearray(b"\1" * 8), bytearray(8)), (bytearray(b"\2" * 8), bytearray(5)), (bytearray(3000), bytearray(8))]
    df = spark.createDataFrame(rows, "k binary, v binary")
    fixed = OrderedTable(df, ["k"], ["v"], value_mode="multi_samelength")
    assert sorted((len(r.k), len(r.v)) for r in check.wrong_sizes(fixed).collect()) == [(8, 5), (3000, 8)]
    assert [len(r.k) for r in check.wrong_sizes(OrderedTable(df, ["k"], ["v"])).collect()] == [3000]

    def handler(batches):
        for b in batches:
            yield b.assign(size=b["v"].map(len))[["size"]]

    assert sorted(r.size for r in check.handle_pairs(fixed, handler, "size int").collect()) == [5, 8, 8, 8]


def test_positions_compare_with_and_without_values(spark):
    t = OrderedTable(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, v int"), ["k"], ["v"], value_mode="multi")
    a = spark.createDataFrame([(0, 1, 1), (1, 1, 2), (2, 2, 1)], "i int, k int, v int")
    b = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, 1, 2)], "i int, k int, v int")
    assert {r.i: r.order for r in t.compare(a, b, ["i"]).collect()} == {0: -1, 1: 0, 2: 1}
    assert {r.i: r.order for r in t.compare(a, b, ["i"], ignore_values=True).collect()} == {0: 0, 1: 0, 2: 1}
