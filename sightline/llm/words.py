"""Words of whole batches of texts: Arrow splits them and tells them apart, so Python sees each distinct word of a slice once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at once; a longer text is split alone.
SLICE_BYTES = 2 << 20
#: Strings that a memory holds, and the characters of the longest.
MEMORY, LONGEST_REMEMBERED = 400_000, 64


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, cut so that the texts of a column have at most SLICE_BYTES together."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def numbered(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The number of each word among the distinct ones, and these."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


class Memory:
    """What a worker remembers of strings of at most LONGEST_REMEMBERED characters: the newer half and the older one, which is forgotten as the newer fills."""

    def __init__(self):
        self.new, self.old = {}, {}

    def get(self, keys: list[str]) -> list:
        """The value of each key, None where it has none."""
        out = list(map(self.new.get, keys))
        if self.old:
            for i, found in enumerate(out):
                if found is None and (found := self.old.get(keys[i])) is not None:
                    out[i] = found
                    self.put(keys[i], found)
        return out

    def put(self, key: str, value) -> None:
        if len(key) <= LONGEST_REMEMBERED:
            if 2 * len(self.new) >= MEMORY:
                self.new, self.old = {}, self.new
            self.new[key] = value


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each start, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each of the runs of the given sizes that values fall into."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def gathered(ids: list[bytes], codes: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row and how many each has, from those of the distinct words (little-endian uint32), the words' numbers and how many words each text has."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
    return flat[ragged(starts[codes], sizes[codes])], sums(sizes[codes], each)
