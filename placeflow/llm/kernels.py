"""Vectorised word kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
STEP = int(_rng.integers(1, 2**63, dtype=np.uint64)) | 1
BACK = pow(STEP, -1, 2**64)
PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) | U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """STEP and its inverse to the powers 0 to n, modulo 2**64."""
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((STEP, BACK)):
            p = np.full(max(n + 1, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a document's edge ends a word."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts[starts < len(data)], ends[ends > 0]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one running sum."""
    p, q = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of document and hash, and each document's bounds in them."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends = spans(data, offsets)
    words = hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), np.maximum(count - width + 1, 0))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(count - width + 1, 0)) - np.maximum(count - width + 1, 0), np.maximum(count - width + 1, 0)) + first[:-1][owner]
    key = np.zeros(len(owner), np.uint64)
    for i in range(width):
        key += words[at + i] * PLACE[i]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = count[short].astype(np.uint64) * PLACE[7]
        for i in range(width - 1):
            more = count[short] > i
            extra[more] += words[first[:-1][short[more]] + i] * PLACE[i]
        owner, key = np.concatenate([owner, short]), np.concatenate([key, extra])
    key = mix(key)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    owner, key = owner[new], key[new]
    return key, np.searchsorted(owner, np.arange(n + 1))


# classes of bytes: 0 white space, 1 letter (every byte of a longer UTF-8 character too), 2 digit, 3 other
CLASS = np.full(256, 3, np.uint8)
CLASS[SPACE] = 0
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[48:58] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of maximal runs of letters, of digits and of other marks."""
    kind = CLASS[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
