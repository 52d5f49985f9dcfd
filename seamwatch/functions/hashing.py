"""Content hashes and distances between 64-bit perceptual hashes.

A perceptual hash travels as 16 hex digits; for arithmetic it is split in two
32-bit halves because an unsigned 64-bit number does not fit a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def half(hex_text: Column, which: int) -> Column:
    """High (0) or low (1) 32 bits of a 16-digit hex hash as bigint."""
    return F.conv(F.substring(F.lower(hex_text), 1 + 8 * which, 8), 16, 10).cast("bigint")


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def hash_bucket(digest_hex: Column, digits: int = 4) -> Column:
    """Leading hex digits of a digest as an int bucket; equal-size buckets by construction."""
    return F.conv(F.substring(digest_hex, 1, digits), 16, 10).cast("int")
