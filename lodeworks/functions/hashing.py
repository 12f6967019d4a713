"""64-bit hashes of substrings, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def char_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): a 64-bit hash of every k consecutive characters; texts are at least k long."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    rolled = np.zeros(max(0, len(codes) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * MIX + codes[j : len(codes) - k + 1 + j]
    counts = lengths - k + 1
    starts = np.cumsum(lengths) - lengths
    keep = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())  # no window runs into the next text
    return mixed(rolled[keep]), np.concatenate([[0], np.cumsum(counts)])


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; by sorting, which is far faster here than the library's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def in_chunks(texts: list[str], characters: int = 2_000_000):
    """(start, end) of consecutive texts of about that many characters in all, one at least."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > characters:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
