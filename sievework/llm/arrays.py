"""NumPy helpers for tasks that work on batches of texts as flat byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one step works on; arrays of 8 bytes per byte stay small and in cache.
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, STEP_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row begins; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    starts = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or len(starts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def steps(starts: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each; a longer row is a range of its own."""
    rows, at = len(starts) - 1, 0
    while at < rows:
        end = int(np.searchsorted(starts, starts[at] + size, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def runs_of(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end; a run never crosses the start of a row."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = starts[(starts > 0) & (starts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def range_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``values[begin:end]``, by one prefix sum of base powers."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[begin]) * powers(_INVERSE, n + 1)[begin]
    return mix(h + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


# Primes below 2**31, so that products and long sums fit 64 bits, and bases.
_MODULI = ((2147483647, 1103515245), (2147483629, 1664525))
_residues: dict[tuple[int, int], np.ndarray] = {}


def _modular_powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo a prime, by doubling."""
    have = _residues.get((base, prime))
    if have is None or len(have) < n:
        have = np.ones(1, dtype=U64)
        while len(have) < max(n, STEP_BYTES + 1):
            have = np.concatenate([have, have * U64(pow(base, len(have), prime)) % U64(prime)])
        if len(have) <= 4 * STEP_BYTES:
            _residues[base, prime] = have
    return have[:n]


def word_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``values[begin:end]`` for words that must not be taken for others.

    Polynomials modulo two primes. Modulo a power of two, as in ``range_hashes``, self-similar
    words of 1,024 letters and more and their complements have one hash, whatever the base.
    """
    n = len(values)
    out = (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93)
    wide = values.astype(U64) + U64(1)
    for prime, base in _MODULI:
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(wide * _modular_powers(base, prime, n) % U64(prime), out=sums[1:])
        back = _modular_powers(pow(base, -1, prime), prime, n + 1)
        h = (sums[end] - sums[begin]) % U64(prime) * back[begin] % U64(prime)
        out = mix(out ^ (h + U64(0x9E3779B97F4A7C15)))
    return out
