"""Hashes with the same value on every engine, so that splits and bits can be reproduced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(key: Column, seed: int = 0) -> Column:
    """Hex digest that fixes a pseudo-random row order for ``seed``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def stable_hash(key: Column, start: int = 1) -> Column:
    """Eight hex digits of the digest, from position ``start``, as a 32-bit number."""
    return F.conv(F.substring(F.md5(key.cast("string")), start, 8), 16, 10).cast("bigint")


def last_digits(key: Column, digits: int) -> Column:
    """The last hex digits of ``stable_hash``, as text."""
    return F.substring(F.md5(key.cast("string")), 9 - digits, digits)


def uniform(key: Column, seed: int = 0) -> Column:
    """Repeatable number in [0, 1)."""
    return stable_hash(F.concat(F.lit(f"{seed}|"), key.cast("string"))) / F.lit(float(2**32))


def fold(key: Column, n_bits: int) -> Column:
    """Bit position of a feature in a vector of ``n_bits``."""
    return F.pmod(stable_hash(key), F.lit(n_bits)).cast("int")


def multiset_digest(key: Column) -> Column:
    """Aggregate: digest of a group's values that does not depend on their order.

    Sums of the digest's four 32-bit words and a count. Unlike a sorted list it is combined
    on the map side and has a fixed size, so a group of any size costs the same. Two words are
    read from the digits at once, the most that fit a number.
    """
    digest = F.md5(key.cast("string"))
    pairs = [F.conv(F.substring(digest, start, 16), 16, -10).cast("bigint") for start in (1, 17)]
    words = [word for pair in pairs for word in (F.shiftrightunsigned(pair, 32), pair.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.md5(
        F.concat_ws(
            "|",
            F.count(key).cast("string"),
            *[F.sum(word).cast("string") for word in words],
        )
    )
