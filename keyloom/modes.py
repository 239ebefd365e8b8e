"""Key and value modes: how a table's keys and values sort, and what they may be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.codecs import reverse_bytes

KEY_MODES = ("usual", "reverse", "ordinal")
VALUE_MODES = ("single", "multi", "multi_reverse", "multi_samelength", "multi_ordinal", "multi_reverse_samelength")
PAGE = 4096
MOST_KEY_BYTES = PAGE // 2 - 26  # 2022 at a page of 4096
MOST_VALUE_BYTES = 0x7FF00000


def sort_key(column: Column, mode: str) -> Column:
    """The expression whose ascending order is the mode's order: bytes from the end for reverse modes, else the column itself."""
    if mode not in KEY_MODES + VALUE_MODES:
        raise ValueError(f"unknown mode {mode}")
    return reverse_bytes(column.cast("binary")) if "reverse" in mode else column


def is_multi(mode: str) -> bool:
    return mode != "single"


def is_same_length(mode: str) -> bool:
    return "samelength" in mode or mode == "multi_ordinal"


def size_problem(column: Column, mode: str, most: int) -> Column:
    """True for raw bytes that the mode forbids: too long, or not of 4 or 8 bytes for ordinals."""
    n = F.octet_length(column)
    return ~n.isin(4, 8) if "ordinal" in mode else n > most
