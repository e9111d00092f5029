"""Word shingles as sorted arrays of 64-bit hashes, and one-permutation sketches of them."""

from __future__ import annotations

from functools import cache

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

_EMPTY = np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows of a UTF-8 text.

    bytes.lower() lowers A-Z only and bytes.split() cuts at space and \\x09-\\x0d only.
    A text with fewer words than a window is one shingle, tagged with its word count;
    without text or words the set is empty.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return _EMPTY
    hashed = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    span = len(tokens) - width + 1
    rolled = hashed[:span] + np.uint64(width)
    for k in range(1, width):
        rolled = mix(rolled) + hashed[k : k + span]
    return np.unique(mix(rolled))


def set_name(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set: equal sets have equal names."""
    return xxh3_128_digest(shingles.tobytes())


@cache
def _probes(bins: int) -> np.ndarray:
    """For each bin its own fixed random order of all bins, in which an empty bin looks for a donor."""
    keys = mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bins, bins)
    return np.argsort(keys, axis=1)


@cache
def _edges(bins: int) -> np.ndarray:
    return np.array([(i << 64) // bins for i in range(bins)], np.uint64)


def one_permutation_sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One hash per shingle, the range cut into bins, the least hash of each bin kept.

    In a sorted set a bin's least hash is the first at or above its lower edge. An empty
    bin copies the first occupied bin in its own random probe order (optimal
    densification), so that every bin still agrees with the Jaccard probability.
    """
    start = np.searchsorted(shingles, _edges(bins))
    filled = np.append(start[1:], len(shingles)) > start
    donor = np.arange(bins)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        probes = _probes(bins)[empty]
        donor[empty] = probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]
    return shingles[start[donor]]


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key per band of the sketch."""
    cells = sketch.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in cells.T:
        key = mix(key + np.uint64(0x9E3779B97F4A7C15)) ^ column
    return mix(key).view(np.int64)


#: 64-bit words of a parity map.
PARITY_WORDS = 4


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Whether each of 256 cells holds an odd number of the set's hashes, as four 64-bit words.

    A cell in which two sets differ holds a hash of just one of them, so the sets differ in
    at least as many hashes as their maps differ in cells.
    """
    odd = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def enough_in_common(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, on the full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * common >= percent * (len(a) + len(b) - common)
