"""Words of a text and their 64-bit hashes, for code that runs inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words remembered by one task before its table of hashes starts anew, bytes of the longest remembered one, and bytes of text taken together.
REMEMBERED, LONGEST, SLICE_BYTES = 200_000, 64, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that the texts (or binaries) of a slice make up about `most` bytes; a longer one stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased: bytes methods treat just these ASCII characters so."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; a shorter text is one run; no words: empty."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    runs = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i]
    return np.unique(mixed(runs))
