"""Vectorised hashing of words and byte windows, shared by the operators.

All hashes are polynomial prefix sums modulo 2**64 over per-byte random
values, finished with a bijective mixer, so a whole block of text is hashed by
a handful of NumPy passes.  The constants are fixed: equal strings hash alike
on every executor and at every input size.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes hashed at a time; bounds the working memory whatever a text's length.
BLOCK = 1 << 20
_BASE = (0x9E3779B97F4A7C15 | 7) & ~2  # = 5 modulo 8: odd, of the largest order
_BASE2 = (0xD1342543DE82EF95 | 7) & ~2
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (SplitMix64) of an array of unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, BLOCK + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[base] = have = (out[0], out[1])
    return have[0][: n + 1], have[1][: n + 1]


def byte_values(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random 64-bit value per byte; A-Z share those of a-z if asked."""
    v = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    if fold_case:
        v[65:91] = v[97:123]
    return v


def byte_class(pattern_bytes) -> np.ndarray:
    """Boolean table of 256 entries, true at the given byte values."""
    t = np.zeros(256, dtype=bool)
    t[list(pattern_bytes)] = True
    return t


#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = byte_class([0x20, *range(0x09, 0x0E)])


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one array, a line feed after each, and where each begins (one more entry: the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buf, np.concatenate(([0], np.cumsum(sizes)))


def words(buf: np.ndarray, gaps: np.ndarray, values: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the maximal runs of bytes that are no gaps; then a hash array for each prefix length (0 where the run isn't longer).

    The array must end in a gap.  It is hashed block by block, each block cut at
    a gap, so memory doesn't follow the size of the array.
    """
    starts, ends, hashes, heads = [], [], [], [[] for _ in prefixes]
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            cut = np.flatnonzero(gaps[buf[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
            else:  # one run longer than a block: up to its end
                while to < n and not gaps[buf[to - 1]]:
                    more = np.flatnonzero(gaps[buf[to : to + BLOCK]])
                    to = to + int(more[0]) + 1 if len(more) else min(n, to + BLOCK)
        part = buf[at:to]
        inside = ~gaps[part]
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = powers(len(part))
        total = np.concatenate((np.zeros(1, U64), np.cumsum(values[part] * up[:-1], dtype=U64)))
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64)))
        for k, out in zip(prefixes, heads):
            long = e - s > k
            out.append(np.where(long, mix((total[np.minimum(s + k, len(part))] - total[s]) * down[s] + U64(k << 32)), U64(0)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), *(np.zeros(0, U64) for _ in prefixes)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes), *(np.concatenate(x) for x in heads)


def windows(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive entries (len - k + 1 of them)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(n, _BASE2 if second else _BASE)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * up[:n], dtype=U64)))
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def slices(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n consecutive numbers begins in a sorted array of them (one more entry: the end)."""
    return np.searchsorted(rows, np.arange(n + 1))
