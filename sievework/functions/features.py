"""Column expressions that turn text into fingerprints. All of them run inside the JVM.

A fingerprint is a sorted array of set bit positions; the dense forms (booleans, text,
vectors) are made from it where something needs them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.hashing import last_digits, stable_hash

# Exact masses of the most abundant isotopes, in unified atomic mass units.
EXACT_MASS = {
    "H": 1.00782503223,
    "B": 11.00930536,
    "C": 12.0,
    "N": 14.00307400443,
    "O": 15.99491461957,
    "F": 18.99840316273,
    "Na": 22.9897692820,
    "Mg": 23.985041697,
    "Si": 27.97692653465,
    "P": 30.97376199842,
    "S": 31.9720711744,
    "Cl": 34.968852682,
    "K": 38.9637064864,
    "Ca": 39.962590863,
    "Br": 78.9183376,
    "I": 126.9044719,
}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, although ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, n: int = 3) -> Column:
    """Lower-case word n-grams of the whole text, in order; short texts give one gram."""

    def grams(words: Column) -> Column:
        rest = lambda i: [F.get(words, i + F.lit(k)) for k in range(1, n)]
        all_grams = F.transform(words, lambda w, i: F.concat_ws(" ", w, *rest(i)))
        count = F.greatest(F.size(words) - F.lit(n - 1), F.least(F.size(words), F.lit(1)))
        return F.slice(all_grams, F.lit(1), count)

    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    return words if n == 1 else bind(words, grams)


def fold_all(features: Column, n_bits: int = 2048) -> Column:
    """Feature strings to the sorted positions of their bits.

    Where few hex digits hold the position, the digits are made distinct before they are read.
    """
    digits = next((d for d in (1, 2) if 16**d % n_bits == 0), None)
    if digits:
        features = F.array_distinct(F.transform(features, lambda f: last_digits(f, digits)))
        bit = lambda h: F.pmod(F.conv(h, 16, 10).cast("bigint"), F.lit(n_bits)).cast("int")
    else:
        bit = lambda f: F.pmod(stable_hash(f), F.lit(n_bits)).cast("int")
    return F.sort_array(F.array_distinct(F.transform(features, bit)))


def text_fingerprint(text: Column, n: int = 3, n_bits: int = 2048) -> Column:
    """Hashed word n-grams; null for text without any word."""
    return bind(shingles(text, n), lambda g: F.when(F.size(g) > 0, fold_all(g, n_bits)))


def pattern_fingerprint(text: Column, patterns: list[str]) -> Column:
    """Sorted positions of the regular expressions that occur in the text."""
    hits = [F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns)]
    return F.when(text.isNotNull(), F.array_compact(F.array(*hits)))


def valid_or_null(valid: Column, feature: Column) -> Column:
    """The feature of a valid row; rows that cannot be parsed keep a null, never an error."""
    return F.when(valid, feature)


def sign_bits(vector: Column) -> Column:
    """Positions of the positive entries of a dense vector."""
    marked = F.transform(vector, lambda v, i: F.when(v > 0, i))
    return F.array_compact(marked)


def to_dense(bits: Column, n_bits: int) -> Column:
    """Sparse positions to an array of booleans.

    Bound, since Spark would compute an expression for ``bits`` again for every position.
    """
    places = F.sequence(F.lit(0), F.lit(n_bits - 1))
    return bind(bits, lambda b: F.transform(places, lambda i: F.array_contains(b, i)))


def to_sparse(dense: Column) -> Column:
    """Array of booleans to sparse positions."""
    return F.array_compact(F.transform(dense, lambda b, i: F.when(b, i)))


def to_bit_text(dense: Column) -> Column:
    """Array of booleans to ``'0101...'``."""
    return F.array_join(F.transform(dense, lambda b: F.when(b, "1").otherwise("0")), "")


def from_bit_text(text: Column) -> Column:
    """``'0101...'`` to an array of booleans; null when another character occurs."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.rlike("^[01]*$"), F.transform(chars, lambda c: c == "1"))


def same_bits(a: Column, b: Column) -> Column:
    """Whether two fingerprints agree in every bit."""
    return a == b


def tanimoto(a: Column, b: Column) -> Column:
    """Common bits over all bits of two sparse fingerprints; 1 when both are empty."""
    total = F.size(a) + F.size(b)
    ratio = lambda common: F.when(total == 0, 1.0).otherwise(common / (total - common))
    return bind(F.size(F.array_intersect(a, b)), ratio)


def exact_weight(structure: Column) -> Column:
    """Sum of exact masses over the formula layer of an InChI string.

    Null for anything it cannot weigh: other text, unknown elements, a second part after a
    dot, or an isotope, charge or proton layer.
    """
    formula = F.try_element_at(F.split(structure, "/"), F.lit(2))
    atom = r"([A-Z][a-z]?)(\d*)"
    symbols = F.regexp_extract_all(formula, F.lit(atom), F.lit(1))
    counts = F.regexp_extract_all(formula, F.lit(atom), F.lit(2))
    masses = F.create_map(*[F.lit(x) for pair in EXACT_MASS.items() for x in pair])
    weights = F.zip_with(
        symbols,
        counts,
        lambda s, c: F.try_element_at(masses, s)
        * F.coalesce(c.try_cast("double"), F.lit(1.0)),
    )
    plain = structure.rlike(r"^InChI=1S?/([A-Z][a-z]?\d*)+(/[chbtms][^/]*)*$")
    return F.when(plain, F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w))
