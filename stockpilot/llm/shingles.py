"""Word-shingle sets and SuperMinHash signatures, in numpy over batches of texts.

Words are the runs of bytes other than ASCII white space of the text with A-Z
lower-cased; a shingle is k adjacent words, as a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_ODD = [U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingles.  With fewer than k words the whole sequence is
    the one shingle; without words the set is empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, U(min(k, len(h))))
    for i in range(min(k, len(h))):
        out = mix(out * _ODD[i % 5] + h[i : i + n])
    return np.unique(out)


def super_minhash(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (one row of m values per set) of sets laid end to
    end in ``elements``; no set is empty, m is at most 256.

    Each element draws a random permutation of the m positions; its value at
    the position of rank j is j plus a random fraction, and a position keeps
    its least value.  All elements draw rank j together; a set stops when each
    position has a value below j + 1, because later ranks can't be lower."""
    sets = len(starts)
    sizes = np.diff(np.append(starts, len(elements)))
    sig = np.full(sets * m, np.iinfo(np.int64).max, np.int64)
    owner = np.repeat(np.arange(sets), sizes)
    seed, perm = elements, None
    for j in range(m):
        draw = mix(seed + U((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = (j + ((draw >> U(32)) * U(m - j) >> U(32))).astype(np.int64)
        if perm is None:
            position = at  # rank 0: the permutations are still the identity
        else:
            each = np.arange(len(seed))
            position = perm[each, at].astype(np.int64)
            perm[each, at] = perm[:, j]
        value = (j << 32) | mix(draw).astype(np.uint32).astype(np.int64)
        np.minimum.at(sig, owner * m + position, value)
        open_ = sig.reshape(sets, m).max(axis=1) >= (j + 1) << 32
        if not open_.any():
            break
        if perm is None or not open_[owner].all():
            stay = open_[owner]
            seed, owner = seed[stay], owner[stay]
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(seed), 1))
                each, at = np.arange(len(seed)), at[stay]
                perm[each, at] = 0
            else:
                perm = perm[stay]
    return sig.reshape(sets, m)


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` signature values."""
    sets, m = signatures.shape
    parts = signatures.astype(np.uint64).reshape(sets, m // rows, rows)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * _ODD[1], (sets, m // rows))
    for i in range(rows):
        key = mix(key * _ODD[2] + parts[:, :, i])
    return key.astype(np.int64)
