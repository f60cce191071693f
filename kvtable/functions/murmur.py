"""Murmur3 x86-32 with a seed, and Bloom filter positions, as Column expressions.

Built from JVM-side operators only.  Products of 32-bit values are taken in
halves, so nothing overflows in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two seeds of a filter's hash pair.
SEED_1, SEED_2 = 0x9747B28C, 0x3C074A61
#: The algorithm's published constants.
C1, C2, ADD, MIX_1, MIX_2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35

_MASK = (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression that names another twice would double at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _times(value: Column, c: int) -> Column:
    def product(a: Column) -> Column:
        high = F.shiftleft((a * (c >> 16)).bitwiseAND(0xFFFF), 16)
        return (a * (c & 0xFFFF) + high).bitwiseAND(_MASK)

    return _let(value, product)


def _rotated(value: Column, n: int) -> Column:
    return _let(value, lambda a: F.shiftleft(a, n).bitwiseAND(_MASK).bitwiseOR(F.shiftright(a, 32 - n)))


def _folded(value: Column, n: int) -> Column:
    return _let(value, lambda a: a.bitwiseXOR(F.shiftright(a, n)))


def _little_endian(digits: Column, n: int) -> Column:
    """The first n bytes of a hex string as a number."""
    swapped = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))]
    return F.conv(F.concat(*swapped), 16, 10).cast("bigint")


def _scrambled(k: Column) -> Column:
    return _times(_rotated(_times(k, C1), 15), C2)


def murmur3(data: Column, seed: int) -> Column:
    """The unsigned 32-bit hash of a BINARY as BIGINT."""
    digits, size = F.hex(data), F.octet_length(data).cast("bigint")
    blocks = F.when(
        size >= 4,
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.floor(size / 4) - 1),
            lambda i: _little_endian(F.substr(digits, (8 * i + 1).cast("int"), F.lit(8)), 4),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    state = F.aggregate(
        blocks,
        F.lit(seed).cast("bigint"),
        lambda h, k: (_rotated(h.bitwiseXOR(_scrambled(k)), 13) * 5 + ADD).bitwiseAND(_MASK),
    )
    rest = F.pmod(size, F.lit(4))
    end = F.substr(digits, (2 * (size - rest) + 1).cast("int"), F.lit(8))
    tail = reduce(
        lambda otherwise, n: F.when(rest == n, _scrambled(_little_endian(end, n))).otherwise(otherwise),
        (3, 2, 1),
        F.lit(0).cast("bigint"),
    )
    h = state.bitwiseXOR(tail).bitwiseXOR(size)
    return _folded(_times(_folded(_times(_folded(h, 16), MIX_1), 13), MIX_2), 16)


def positions(h1: Column, h2: Column, bits: int, hashes: int) -> Column:
    """ARRAY<INT>: (h1 + i * h2) mod bits for each i."""
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(hashes - 1).cast("bigint")), lambda i: F.pmod(h1 + i * h2, F.lit(bits)).cast("int")
    )
