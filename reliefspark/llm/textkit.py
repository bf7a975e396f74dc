"""Words of whole Arrow columns by array operations: no Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Fixed value: ASCII white space.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Fixed value: which bits of a word of eight bytes count where it holds so many.
HELD = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


@lru_cache
def lowered() -> np.ndarray:
    """By byte: itself, A-Z as a-z."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


class Spans:
    """The spans ``data[start:end]`` as words of eight bytes (the last filled up with zeros), with a 64-bit hash of each.

    A word is mixed with its place before it is added, so equal sums of
    different spans are left to chance, whatever patterns the texts have; where
    equality decides a result, ``equal`` compares the bytes. With ``lower`` A-Z
    count as a-z.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = lowered()[data] if lower else data
        self.lengths = ends - starts
        counts = (self.lengths + 7) >> 3
        self.offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=self.offsets[1:])
        place = np.arange(self.offsets[-1]) - np.repeat(self.offsets[:-1], counts)
        at = np.repeat(starts, counts) + 8 * place
        self.words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at] & HELD[np.minimum(np.repeat(ends, counts) - at, 8)]
        sums = np.zeros(len(self.words) + 1, U64)
        np.cumsum(mix(self.words ^ ((place + 1).astype(U64) * U64(0x9E3779B97F4A7C15))), out=sums[1:])
        self.hashes = mix(sums[self.offsets[1:]] - sums[self.offsets[:-1]] + self.lengths.astype(U64) * U64(0xA24BAED4963EE407))

    def equal(self, a: np.ndarray, b: np.ndarray, other: Spans | KnownSpans | None = None) -> np.ndarray:
        """Whether span ``a[i]`` has the bytes of span ``b[i]`` (of ``other``)."""
        other = other or self
        out = self.lengths[a] == other.lengths[b]
        same = np.flatnonzero(out)
        counts = np.diff(self.offsets)[a[same]]
        mine, offsets = ragged(self.offsets[a[same]], counts)
        theirs, _ = ragged(other.offsets[b[same]], counts)
        unlike = np.zeros(len(mine) + 1, np.int64)
        np.cumsum(self.words[mine] != other.words[theirs], out=unlike[1:])
        out[same] = unlike[offsets[1:]] == unlike[offsets[:-1]]
        return out

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(hash, one position of each distinct span, number of its span for every position, how many of these have hashes of their own).

        By the hashes, each compared with the first of its group. Of spans with
        the same hash, the others come last, told apart by their bytes.
        """
        keys, first, number = grouped(self.hashes)
        own, beyond = len(keys), {}
        for i in np.flatnonzero(~self.equal(np.arange(len(number)), first[number])).tolist():
            number[i] = beyond.setdefault(self.words[self.offsets[i] : self.offsets[i + 1]].tobytes() + b"%d" % self.lengths[i], (own + len(beyond), i))[0]
        extra = np.array([i for _, i in beyond.values()], np.int64)
        return np.concatenate([keys, self.hashes[extra]]), np.concatenate([first, extra]), number, own


class Growing:
    """An array that is added to; room grows twofold, so that adding costs what is added."""

    def __init__(self, kind: type):
        self.room, self.size = np.empty(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.size + len(values)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class KnownSpans:
    """Bytes of spans that were met before, in the order in which they were added."""

    def __init__(self):
        self._words, self._lengths, self._offsets = Growing(U64), Growing(np.int32), Growing(np.int64)
        self._offsets.add(np.zeros(1, np.int64))

    words = property(lambda self: self._words.values)
    lengths = property(lambda self: self._lengths.values)
    offsets = property(lambda self: self._offsets.values)

    def add(self, spans: Spans, at: np.ndarray) -> None:
        spots, offsets = ragged(spans.offsets[at], np.diff(spans.offsets)[at])
        self._offsets.add(self._words.size + offsets[1:])
        self._words.add(spans.words[spots])
        self._lengths.add(spans.lengths[at])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the spans ``data[start:end]``."""
    return Spans(data, starts, ends, lower).hashes


def chained(keys: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` keys that begin at each position."""
    n = len(keys) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, length, U64)
    for i in range(length):
        out = mix(out * U64(0x9E3779B97F4A7C15) + keys[i : i + n])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("") if column.null_count else column
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of record batches of about ``max_bytes`` of text, one row at least, with the text's bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    release()


def release() -> None:
    """Hands freed memory back to the system: an idle worker should not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross rows: (starts, ends, number of runs before each row and at the end)."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | fresh[1:-1]
    end[:-1] &= ~word[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache
def not_in(chars: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(chars)] = False
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(not_in(separators)[data], offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all elements of the spans one after another, offsets of the spans there)."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1]), offsets


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, one position of each, number of its key for every position)."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = held[1:] != held[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return held[new], order[new], number


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow text column."""
    at, offsets = ragged(starts, ends - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())
