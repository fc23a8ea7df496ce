"""Bounds of micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

MOST_BYTES, LEAST_FILES, MOST_FILES = 256 << 20, 5, 1000


def bounded_prefix(sizes: Sequence[int], most_bytes: int = MOST_BYTES, least: int = LEAST_FILES, most: int = MOST_FILES) -> int:
    """How many of the first files make one batch: as many as fit, but for `least` at least and `most` at most."""
    total = 0
    for k, size in enumerate(sizes):
        if k >= most or (k >= least and total + size > most_bytes):
            return k
        total += size
    return len(sizes)


def estimated(sizes: Sequence[int], files: int, sample: int = 20) -> int:
    """Bytes of so many files by the mean of the first ones."""
    known = sizes[:sample]
    return round(sum(known) / len(known) * files) if known else 0


def rate_options(most_bytes: int = MOST_BYTES, most: int = MOST_FILES) -> dict[str, str]:
    """The same bounds as options of a file stream; Spark takes one of them, the bytes."""
    return {"maxBytesPerTrigger": str(most_bytes)} if most_bytes else {"maxFilesPerTrigger": str(most)}
