"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on *blocks*: runs of whole documents, as one array of UTF-8
bytes and an array of offsets, so that numpy runs over megabytes at a time and
never over single words.  A block holds ``BLOCK_BYTES`` at most, or one longer
document, which bounds a worker's memory.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import cached_property, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base & _MASK, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(0x9E3779B97F4A7C15)


#: Longer spans are hashed one by one.
LONG = 256
_CHAIN = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number; zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def _steps(eights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(spans that reach that far, their next eight bytes with zeros beyond the end), until all are read."""
    live, at, left = np.arange(len(starts)), starts, ends - starts
    while True:
        go = left > 0
        if not go.all():
            live, at, left = live[go], at[go], left[go]
        if not len(live):
            return
        gone = (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)).astype(np.uint64)
        yield live, (eights[at] << gone) >> gone
        at, left = at + 8, left - 8


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans are equal anywhere.

    Each eight bytes go through a mixing step, so that no structure of the text
    carries over to the hashes; spans over ``LONG`` bytes have BLAKE2b's.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + seeds(1 + which, 1))
    short = np.flatnonzero(sizes <= LONG)
    for live, chunk in _steps(_eights(data), starts[short], ends[short]):
        at = short[live]
        out[at] = mix(out[at] * _CHAIN[which] + mix(chunk ^ _CHAIN[1 - which]))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans numbered ``a`` and ``b`` have the same bytes."""
    size = ends - starts
    out = size[a] == size[b]
    short = np.flatnonzero(out & (size[a] <= LONG))
    eights = _eights(data)
    for (live, x), (_, y) in zip(_steps(eights, starts[a[short]], ends[a[short]]), _steps(eights, starts[b[short]], ends[b[short]])):
        out[short[live[x != y]]] = False
    for k in np.flatnonzero(out & (size[a] > LONG)).tolist():
        i, j = a[k], b[k]
        out[k] = np.array_equal(data[starts[i] : ends[i]], data[starts[j] : ends[j]])
    return out


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal exactly where the spans' bytes are."""
    hashes = span_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not equal_spans(data, starts, ends, order[:-1][same], order[1:][same]).all():  # different spans of one hash
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(data[i:j].tobytes(), len(known)) for i, j in zip(starts, ends)], np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], ~same))) if len(order) else 0
    return out


@dataclass
class Block:
    """Documents ``first`` to ``first + n`` of a batch, with their words."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, positions: np.ndarray) -> np.ndarray:
        """The document that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    @property
    def starts(self) -> np.ndarray:
        """First bytes of the words ``[^\\x20\\x09-\\x0D]+``."""
        return self._bounds[0]

    @property
    def ends(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Where each document's words begin in ``starts``."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_offsets))

    def word_hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, which)

    @cached_property
    def word_numbers(self) -> np.ndarray:
        """Numbers that are equal exactly where the words are."""
        return span_numbers(self.data, self.starts, self.ends)

    @cached_property
    def chars(self) -> np.ndarray:
        """Code points before each byte position."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~_CONTINUATION[self.data], out=out[1:])
        return out


def ngram_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words; the caller drops runs that leave a document."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    base, out = seeds(11 + which, n), np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * (base[k] | np.uint64(1))
    return mix(out)


def whole_ngrams(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """Mask over word positions 0..len-n: the run of ``n`` stays in one document."""
    total = int(word_offsets[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for end in word_offsets[1:-1]:
        ok[max(0, end - n + 1) : end] = False
    return ok


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the positions inside any run [start, start + n)."""
    if not len(starts):
        return np.zeros(total, bool)
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null texts count as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's documents in order, in blocks."""
    data, at = text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that gives unused memory back when its task ends, as Spark keeps the worker for the next one."""

    @wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return tidy


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
