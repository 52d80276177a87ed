"""Words of whole Arrow batches as numbers, so that each different word is worked out once a task.

Ragged columns are pairs ``(values, offsets)`` of numpy arrays, as Arrow's lists are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20       # texts worked on together (or one longer text)
SLICE_ROWS = 1 << 14


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths, dtype=np.int64)]


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``rows`` of ``(values, offsets)``, in that order."""
    sizes = offsets[rows + 1] - offsets[rows]
    out = offsets_of(sizes)
    return values[np.repeat(offsets[rows] - out[:-1], sizes) + np.arange(out[-1])], out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array from UTF-8 bytes that are known to be valid."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch``, at most ``SLICE_ROWS`` with at most ``most`` bytes of text, at least one row each."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = min(a + SLICE_ROWS, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
        yield batch.slice(a, b - a)
        a = b


class WordBook:
    """Numbers words and keeps a ragged row of values for each.

    ``learn(words)`` gives ``(values, offsets)`` of new words. The book starts
    anew when it holds ``most`` words, so its memory is bounded.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.values, self.offsets = self.learn([])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of ``words``, rows of ``values`` and ``offsets`` until the next call."""
        if len(self.number) > self.most:
            self.clear()
        coded = words.dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = [w for w in different if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            values, offsets = self.learn(new)
            self.values = np.concatenate([self.values, values])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        numbers = np.fromiter(map(self.number.__getitem__, different), np.int64, len(different))
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ragged rows of ``words``."""
        numbers = self.numbers(words)
        return gather(self.values, self.offsets, numbers)
