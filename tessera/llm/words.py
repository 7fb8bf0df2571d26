"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word's hash is a polynomial in its bytes with odd base modulo 2**64, mixed at
the end. All hashes of a buffer come from one running sum: no Python loop over
words. Letters A-Z hash as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes of text that are handled at once, unless a single text is longer.
SLICE = 2 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: The words are [^\x20\x09-\x0D]+.
BY_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: After A-Z have become a-z, the words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
BY_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes, never 0, of the given spans."""
    n = len(data)
    power, inverse = _powers(max(SLICE + 65536, n if n <= SLICE + 65536 else 1 << n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes()[data] * power[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    h[h == 0] = 1
    return h


def slices(texts: Sequence[bytes | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most limit bytes, or one longer text."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if held and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def tokenize(texts: Sequence[bytes | None], separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words start; the last entry is their number."""
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]), np.uint8)
    starts, ends = spans(data, separator)
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes(data, starts, ends), bounds
