"""Word shingles of many texts at once, as 64-bit hashes, by whole-array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_WORD = np.array([chr(i).isalnum() or i == 95 if i < 128 else True for i in range(256)])


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def powers_to(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, 0 to n - 1 at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            a = np.full(1 << int(n).bit_length(), base, dtype=np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many each text has. Words are runs of letters, digits, underscores and non-ASCII bytes."""
    flat = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    inside = _WORD[flat]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, ends = edges[0::2], edges[1::2]
    power, inverse = powers_to(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[begins]) * inverse[begins])
    bounds = np.cumsum([1] + [len(p) + 1 for p in parts])
    at = np.searchsorted(begins, bounds)
    return hashes, np.diff(at)


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text in turn its sorted distinct shingles, compared without case; a shorter text is one shingle, a text without words none."""
    start = 0
    while start < len(texts):
        parts, size = [], 0
        while start < len(texts) and size < _PIECE:
            parts.append(texts[start].lower().encode("utf-8", "replace"))
            size += len(parts[-1])
            start += 1
        hashes, counts = word_hashes(parts)
        n = max(0, len(hashes) - words + 1)
        runs = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            runs = mixed(runs * np.uint64(31) + hashes[k : k + n] + np.uint64(k + 1))
        at = 0
        for count in counts.tolist():
            if count >= words:
                yield np.unique(runs[at : at + count - words + 1])
            elif count:
                one = np.zeros(1, dtype=np.uint64)
                for h in hashes[at : at + count]:
                    one = mixed(one * np.uint64(37) + h)
                yield one
            else:
                yield hashes[:0]
            at += count
