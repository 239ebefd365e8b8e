"""Text codecs, byte-string slices and order-preserving keys, as Column expressions; base58 needs a Pandas UDF, the bits of doubles Arrow.

Decoders give null for input that isn't valid (and for null); ``is_*`` tell which input is.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the alphabet of base58.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
SIGN = -(1 << 63)


def wrapped(text: Column, width: int) -> Column:
    """Lines of ``width`` characters; 0 leaves the text whole."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n") if width else text


def to_hex(b: Column, *, upper: bool = False, wrap: int = 0) -> Column:
    h = F.hex(b)
    return wrapped(h if upper else F.lower(h), wrap - wrap % 2 if wrap > 1 else wrap)


def _tight(text: Column, ignore_spaces: bool) -> Column:
    return F.regexp_replace(text, r"\s+", "") if ignore_spaces else text


def is_hex(text: Column, *, ignore_spaces: bool = False) -> Column:
    """Whether the text is one or more pairs of hexadecimal digits."""
    return _tight(text, ignore_spaces).rlike(r"\A([0-9A-Fa-f]{2})+\z")


def from_hex(text: Column, *, ignore_spaces: bool = False) -> Column:
    t = _tight(text, ignore_spaces)
    return F.when(t.rlike(r"\A([0-9A-Fa-f]{2})*\z"), F.unhex(t))


def to_base64(b: Column, *, wrap: int = 0) -> Column:
    return wrapped(F.regexp_replace(F.base64(b), "[\r\n]", ""), wrap)


def is_base64(text: Column, *, ignore_spaces: bool = False) -> Column:
    """Whether the text is one or more full groups of four, padding included."""
    return _tight(text, ignore_spaces).rlike(r"\A([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)\z")


def from_base64(text: Column, *, ignore_spaces: bool = False) -> Column:
    t = _tight(text, ignore_spaces)
    return F.when(is_base64(t) | (t == ""), F.unbase64(t))


def base58_text(raw: bytes) -> str:
    zeros = len(raw) - len(raw.lstrip(b"\0"))
    n, out = int.from_bytes(raw, "big"), []
    while n:
        n, r = divmod(n, 58)
        out.append(BASE58[r])
    return "1" * zeros + "".join(reversed(out))


def base58_bytes(text: str) -> bytes | None:
    n = 0
    for c in text:
        k = BASE58.find(c)
        if k < 0:
            return None
        n = n * 58 + k
    ones = len(text) - len(text.lstrip("1"))
    return b"\0" * ones + n.to_bytes((n.bit_length() + 7) // 8, "big")


def to_base58(b: Column) -> Column:
    @F.pandas_udf("string")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else base58_text(bytes(x)))

    return encode(b)


def from_base58(text: Column) -> Column:
    @F.pandas_udf("binary")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else base58_bytes(x))

    return decode(text)


def is_base58(text: Column) -> Column:
    return text.rlike(f"\\A[{BASE58}]*\\z")


def is_printable(b: Column, *, utf8: bool = True) -> Column:
    """Whether all is visible ASCII or space (with ``utf8``, or well-formed UTF-8 beyond ASCII); empty input isn't."""
    ok = F.decode(F.when(F.is_valid_utf8(b.cast("string")), b), "UTF-8").rlike(r"\A[^\x00-\x1F\x7F-\x9F]+\z") if utf8 else F.hex(b).rlike(r"\A([2-6][0-9A-F]|7[0-9A-E])+\z")
    return F.coalesce(ok, F.when(b.isNotNull(), False))


def head(b: Column, n: int) -> Column:
    return F.substring(b, 1, n)


def tail(b: Column, n: int) -> Column:
    return F.when(F.octet_length(b) <= n, b).otherwise(F.substring(b, -n, n)) if n else F.substring(b, 1, 0)


def middle(b: Column, start: int, n: int) -> Column:
    return F.substring(b, start + 1, n)


def safe(part: Column, b: Column, n: int) -> Column:
    """``part`` where b has n bytes, else null: the checked forms of head, tail, middle and the removals."""
    return F.when(F.octet_length(b) >= n, part)


def remove_prefix(b: Column, n: int) -> Column:
    return F.substring(b, F.lit(n + 1), F.greatest(F.octet_length(b) - n, F.lit(0)))


def remove_suffix(b: Column, n: int) -> Column:
    return F.substring(b, F.lit(1), F.greatest(F.octet_length(b) - n, F.lit(0)))


def big_endian(n: Column, size: int) -> Column:
    """An integer as ``size`` bytes, most significant first, so that byte order is the order of non-negative numbers."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("bigint")), 16, "0"), F.lit(2 * size)))


def reverse_bytes(b: Column) -> Column:
    """The bytes from last to first. (Spark's own ``reverse`` goes by UTF-8 characters and damages bytes that aren't.)"""
    return F.unhex(F.regexp_replace(F.reverse(F.hex(b)), "(.)(.)", "$2$1"))


def little_endian(n: Column, size: int) -> Column:
    return reverse_bytes(big_endian(n, size))


def uint_of(b: Column, size: int, *, adapt: bool = False) -> Column:
    """The unsigned little-endian number in b, as DECIMAL(20,0); null unless b has ``size`` bytes (or at most, with ``adapt``: 1, 2, 4 or 8)."""
    n = F.octet_length(b)
    fits = n.isin(*[s for s in (1, 2, 4, 8) if s <= size]) if adapt else n == size
    return F.when(fits, F.conv(F.hex(reverse_bytes(b)), 16, 10).cast("decimal(20,0)"))


def int_of(b: Column, size: int) -> Column:
    """The signed little-endian number in b; null unless b has ``size`` bytes."""
    u = uint_of(b, size)
    return F.when(u >= F.lit(Decimal(1 << (8 * size - 1))).cast("decimal(20,0)"), u - F.lit(Decimal(1 << (8 * size))).cast("decimal(21,0)")).otherwise(u).cast("bigint")


def key_from_i64(n: Column) -> Column:
    """Eight bytes whose byte order is the order of signed numbers: the sign bit is flipped."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint").bitwiseXOR(F.lit(SIGN))), 16, "0"))


def i64_from_key(b: Column) -> Column:
    return _signed(b, 16)


def _signed(b: Column, digits: int) -> Column:
    half = 1 << (4 * digits - 1)
    return (F.conv(F.hex(b), 16, 10).cast("decimal(20,0)") - F.lit(Decimal(half)).cast("decimal(20,0)")).cast("bigint")


def key_from_i32(n: Column) -> Column:
    return F.unhex(F.right(F.lpad(F.hex((n.cast("bigint") + (1 << 31))), 16, "0"), F.lit(8)))


def i32_from_key(b: Column) -> Column:
    return _signed(b, 8).cast("int")


def key_from_double(x: Column) -> Column:
    """Eight bytes in the order of doubles: all bits of negative numbers are flipped, the sign bit of others. -0.0 sorts just before 0.0."""

    @F.arrow_udf("binary")
    def encode(x: pa.Array) -> pa.Array:
        bits = x.to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64)
        top = np.uint64(1 << 63)
        data = np.where(bits & top, ~bits, bits | top).astype(">u8").tobytes()
        places = np.arange(len(x) + 1, dtype=np.int32) * 8
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(places), pa.py_buffer(data)])

    return F.when(x.isNotNull(), encode(F.coalesce(x.cast("double"), F.lit(0.0))))


def double_from_key(b: Column) -> Column:
    @F.arrow_udf("double")
    def decode(x: pa.Array) -> pa.Array:
        places = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4)
        raw = np.frombuffer(x.buffers()[2], ">u8", len(x), int(places[0])).astype(np.uint64)
        top = np.uint64(1 << 63)
        return pa.array(np.where(raw & top, raw & ~top, ~raw).view(np.float64))

    return F.when(F.octet_length(b) == 8, decode(F.coalesce(F.when(F.octet_length(b) == 8, b), F.unhex(F.lit("00" * 8)))))


def key_from_float(x: Column) -> Column:
    """As for doubles, of the float's exact double value, so both sort together."""
    return key_from_double(x.cast("double"))


def key_from_json_integer(n: Column) -> Column:
    """The key of the equal double, for whole numbers of at most 53 bits; null beyond."""
    return F.when(F.abs(n.cast("bigint")) <= (1 << 53) - 1, key_from_double(n.cast("double")))


def ratio_digits(part: Column, whole: Column, precision: int) -> Column:
    """part / whole as decimal text, exact to ``precision`` places (half up); null if whole is 0."""
    return F.when(whole != 0, F.round(part.cast("decimal(38,18)") / whole.cast("decimal(20,0)"), precision).cast(f"decimal(38,{precision})").cast("string"))


def ratio_percent(part: Column, whole: Column, precision: int = 2) -> Column:
    return F.concat(ratio_digits(part.cast("decimal(20,0)") * 100, whole, precision), F.lit("%"))


def debug_text(b: Column) -> Column:
    """Printable bytes as they are in quotes, others in hexadecimal."""
    return F.when(is_printable(b), F.concat(F.lit("'"), F.decode(b, "UTF-8"), F.lit("'"))).otherwise(to_hex(b))
