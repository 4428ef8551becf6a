"""Words, word hashes and shingle sets of many texts at once, in numpy over UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
TERM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []
#: Words that are hashed at once.
BLOCK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, U(x))])) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def payload(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column, one 10 between rows, and where each row begins; null counts as empty."""
    rows = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in rows], out=starts[1:])
    return np.frombuffer(b"\n".join(rows) + b"\n", np.uint8), starts


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each row the number of words before it."""
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap])))
    begin, end = edge[::2], edge[1::2]
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z if lower."""
    out = np.empty(len(begin), np.uint64)
    value = BYTE[LOWER] if lower else BYTE
    for at in range(0, len(begin), BLOCK):
        b, e = begin[at : at + BLOCK], end[at : at + BLOCK]
        first = int(b[0])
        seg = buf[first : int(e[-1])]
        up, down = _powers(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(value[seg] * up[: len(seg)], out=sums[1:])
        b, e = b - first, e - first
        out[at : at + BLOCK] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * TERM[0])
    return out


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, with words hashes[bounds[i]:bounds[i+1]], its sorted distinct k-word shingles.

    With fewer than k words (but some) the whole sequence is the one shingle.
    """
    n = len(hashes)
    run = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if n >= k else 0):
        run += hashes[j : n - k + 1 + j] * TERM[j]
    run = mix(run)
    out = []
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - b >= k:
            out.append(np.unique(run[b : e - k + 1]))
        elif e > b:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                short = (hashes[b:e] * TERM[: e - b]).sum(dtype=np.uint64) + TERM[32 + e - b]
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set's content."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(s ^ TERM[40]).sum(dtype=np.uint64) + U(len(s)) * TERM[41] for s in sets], np.uint64))
