"""Bit words and hashes for sets of small integers and Bloom filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, long

# 32-bit FNV.
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF
WORD = 64


def word_index(position: Column | str) -> Column:
    """The 64-bit word of a position; NULL for negative positions."""
    p = col(position).cast("long")
    return F.when(p >= 0, F.shiftright(p, 6))


def word_mask(position: Column | str) -> Column:
    """The bit of a position in its word; NULL for negative positions."""
    p = col(position).cast("long")
    return F.when(p >= 0, F.call_function("shiftleft", long(1), (p % WORD).cast("int")))


def test_bit(bits: Column | str, position: Column | str) -> Column:
    return col(bits).bitwiseAND(word_mask(position)) != 0


def clear_bit(bits: Column | str, position: Column | str) -> Column:
    return col(bits).bitwiseAND(F.bitwise_not(word_mask(position)))


def capacity(size: int) -> int:
    """Positions that a set of a given size holds: whole words."""
    return -(-size // WORD) * WORD


def _bytes(text: Column | str) -> Column:
    """UTF-8 bytes as numbers."""
    pairs = F.filter(F.split(F.hex(F.encode(col(text), "UTF-8")), r"(?<=\G..)"), lambda h: h != "")
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))


def fnv1(text: Column | str) -> Column:
    """Multiply, then mix in the byte."""
    return F.aggregate(_bytes(text), long(FNV_OFFSET), lambda h, b: (h * FNV_PRIME).bitwiseAND(F.lit(MASK32)).bitwiseXOR(b))


def fnv1a(text: Column | str) -> Column:
    """Mix in the byte, then multiply."""
    return F.aggregate(_bytes(text), long(FNV_OFFSET), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(MASK32)))
