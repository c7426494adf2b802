"""Words of many texts as numbers, for use inside tasks: runs of characters other than the six of ASCII white space."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: An odd multiplier; its powers are the weights of places in rolling hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of `texts`, one text after another, and the place where each text's begin (one more entry than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    parts = split.flatten()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    filled = pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0
    bounds = np.concatenate([[0], np.cumsum(filled)])[bounds]
    coded = parts.filter(pa.array(filled)).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64), bounds.astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` numbers in a row; `len(hashes) - size + 1` of them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    # Doubling: a run of 2m numbers is a run of m and the m after it.
    runs, width, done, rest = hashes, 1, 0, size
    while rest:
        if rest & 1:
            out += runs[done : done + n] * _power(done)
            done += width
        rest >>= 1
        if rest:
            runs = runs[:-width] + runs[width:] * _power(width)
            width *= 2
    return mixed(out + np.uint64(size))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(BASE), k, 1 << 64))


def within(bounds: np.ndarray, total: int, size: int) -> np.ndarray:
    """Which of the `total - size + 1` runs of `size` words lie in one text."""
    if total < size:
        return np.empty(0, bool)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(total - size + 1) + size <= ends[: total - size + 1]


def give_back() -> None:
    """Return freed memory to the system. Workers are used again by the next stage, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with glibc alone
    if trim is not None:
        trim(0)
