"""Arrow batches of bounded size, and ragged arrays (values with offsets), for code inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that one step holds at once; a longer text makes a step of its own.
STEP_BYTES = 4 << 20


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The texts, null as empty, with 64-bit offsets. A slice is copied: pc.ascii_lower gives
    wrong offsets for one whose data do not begin at 0."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def hand_back() -> None:
    """What is free goes back to the system: a worker stays after its task, and others run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def steps(batches: Iterator[pa.RecordBatch], name: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about ``limit`` bytes together; nothing is copied."""
    hand_back()
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0), dtype=np.int64)
        step = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    hand_back()


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list array and the row of each value."""
    values, parents = lists.flatten(), np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
    return values, parents


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without white space 20, 09-0D) and the row of each."""
    values, rows = flat(pc.ascii_split_whitespace(texts))
    real = np.asarray(pc.greater(pc.binary_length(values), 0))
    return (values, rows) if real.all() else (values.filter(pa.array(real)), rows[real])


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, and these."""
    encoded = values.dictionary_encode()
    return np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary


def strings(values: pa.Array) -> list[str]:
    """The values as a list (faster than to_pylist)."""
    return values.to_numpy(zero_copy_only=False).tolist()


def ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of whole numbers as one array and the offsets."""
    offsets = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=offsets[1:])
    out = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(offsets[-1]))
    return out, offsets


def take(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``which``, one after the other, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(offsets[which] - (ends - lengths), lengths) + np.arange(total)], lengths


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


#: What operators keep in a worker from task to task, by what lets go of it.
_KEPT: list = []


def kept(cached):
    """Marks a cached function whose results a worker keeps; another operator's task lets go of them (``drop_kept``)."""
    _KEPT.append(cached.cache_clear)
    return cached


def drop_kept() -> None:
    for clear in _KEPT:
        clear()


class Remembered:
    """Encoded strings that one Python worker keeps between batches, at most ``limit`` of them."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.values, self.offsets = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values and offsets of all kept strings, and the place of each of these."""
        which = np.fromiter(map(self.places.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(which < 0)
        if len(new) and len(self.offsets) - 1 + len(new) > self.limit:
            self._clear()
            new = np.arange(len(strings))
        if len(new):
            fresh = [strings[i] for i in new.tolist()]
            values, offsets = self.encode(fresh)
            first = len(self.offsets) - 1  # strings that come twice have two places
            self.places.update(zip(fresh, range(first, first + len(fresh))))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            self.values = np.concatenate([self.values, values])
            which[new] = np.arange(first, first + len(fresh))
        return self.values, self.offsets, which
