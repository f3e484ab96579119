"""Hash families as Column expressions: every executor, and every SQL engine with SHA-256, computes the same numbers."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prime and the multiplier that the published signatures and cells depend on.
PRIME = 2**31 - 1
ROW_SEED_STEP = 2654435761


def sha_prefix(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the SHA-256 of a text, as a decimal without sign."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, digits), 16, 10).cast("decimal(20,0)")


def slot(prefix: int | Column, item: Column, width: int) -> Column:
    """Where `prefix:item` falls among `width` places."""
    prefix = F.lit(str(prefix)) if isinstance(prefix, int) else prefix.cast("string")
    return (sha_prefix(F.concat(prefix, F.lit(":"), item.cast("string")), 16) % F.lit(width).cast("decimal(20,0)")).cast("int")


def row_seed(row: int) -> int:
    return row * ROW_SEED_STEP + 1


def bloom_size(capacity: int, error_rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many elements at such a false-positive rate."""
    if capacity <= 0 or not 0 < error_rate < 1:
        raise ValueError("capacity is positive, and error_rate between 0 and 1")
    bits = math.ceil(-capacity * math.log(error_rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def minhash_parameters(hashes: int, seed: int = 42) -> list[tuple[int, int]]:
    """(multiplier, shift) of each function: all multipliers are drawn first."""
    if hashes <= 0:
        raise ValueError("at least one hash function")
    draw = random.Random(seed)
    multipliers = [draw.randint(1, PRIME - 1) for _ in range(hashes)]
    return list(zip(multipliers, [draw.randint(0, PRIME - 1) for _ in range(hashes)], strict=True))


def element(member: Column) -> Column:
    """A set member as a 32-bit number."""
    return sha_prefix(member.cast("string"), 8).cast("long")


def element_of(text: bytes) -> int:
    """`element` of a member, given its text in UTF-8."""
    return int(hashlib.sha256(text).hexdigest()[:8], 16)


def bands_and_rows(hashes: int, bands: int) -> tuple[int, int]:
    """Bands that divide the signature as nearly as the count asked for; a last odd hash stays unused."""
    if not 0 < bands <= hashes:
        raise ValueError("bands is from 1 to the number of hashes")
    if hashes % bands:
        bands = max(1, hashes // (hashes // bands))
    return bands, hashes // bands
