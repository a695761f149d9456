"""Content hashes, token hashes and bit arithmetic."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMHASH_BITS = 60  # 15 hex digits of md5: stays positive in a signed bigint


def content_hash(col: Column) -> Column:
    """sha-256 of a string or binary value; null stays null."""
    return F.sha2(col, 256)


def token_hash(token: Column) -> Column:
    """First 60 bits of md5 as a bigint: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint")


def md5_bits(token: bytes) -> int:
    """`token_hash` of one token in Python."""
    return int.from_bytes(md5(token, usedforsecurity=False).digest()[:8], "big") >> 64 - SIMHASH_BITS


def words(text: Column) -> Column:
    """Lower-cased whitespace words of a text."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grid_mean(grid: Column) -> Column:
    """Mean of 64 grey cells, added up in order."""
    return F.aggregate(grid, F.lit(0.0), lambda total, x: total + x) / F.lit(64.0)


def grid_halves(grid: str, mean: str, kind: str = "average") -> tuple[Column, Column]:
    """64 perceptual-hash bits of a grey grid of doubles, as two 32-bit halves (hi, lo).

    Takes column names. `average` compares each of 64 cells with their `mean`;
    `difference` compares each cell of an 8-row, 9-column grid with its right
    neighbour. Top left is the most significant bit. A null grid, or one of another
    size, gives null halves.
    """
    if kind == "average":
        cells, tests = 64, [f"{grid}[{i}] > {mean}" for i in range(64)]
    elif kind == "difference":
        cells, tests = 72, [f"{grid}[{r * 9 + c + 1}] > {grid}[{r * 9 + c}]" for r in range(8) for c in range(8)]
    else:
        raise ValueError(f"unknown fingerprint kind {kind!r}")

    def half(part: list[str]) -> Column:
        # SQL text, not Column calls: one call to the JVM for all the bits.
        bits = " | ".join(f"if({test}, {1 << (31 - i)}L, 0L)" for i, test in enumerate(part))
        return F.expr(f"CASE WHEN size({grid}) = {cells} THEN {bits} END")

    return half(tests[:32]), half(tests[32:])


def join_halves(hi: Column, lo: Column) -> Column:
    """hi, lo -> one signed 64-bit hash."""
    return F.shiftleft(hi, 32).bitwiseOR(lo)
