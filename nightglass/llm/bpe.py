"""Byte-level BPE encoding and decoding with a contiguous rank array.

A pre-token ("short word") is held as the ids of its parts and, beside them,
the rank of each adjacent pair in one contiguous list.  The minimum is found by
a scan, its boundary is deleted and the two neighbouring ranks are refreshed.
Pre-tokens over ``LONG`` bytes merge through a heap of (rank, position), which
gives the same parts without the quadratic scan.

The pre-tokens of a batch of texts are numbered by hashes of their bytes (and
compared byte by byte, so that a number is exactly a pre-token), and those that
aren't known are encoded together: the rank arrays of all words of up to
``WIDTHS[-1]`` bytes are the rows of one numpy array, and each pass finds every
row's minimum, deletes its boundary and refreshes its neighbours.  Known
pre-tokens are kept in arrays that are emptied at ``CACHE`` of them or
``CACHE_BYTES``, which bounds a worker's memory at any size of corpus.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from nightglass.llm import textcore as tc
from nightglass.llm.packed import found_in
from nightglass.llm.textcore import column, tidied

LONG = 400
WIDTHS = (6, 10, 16, 28)
CACHE, CACHE_BYTES = 400_000, 1 << 25
BATCH_CHARS = 1_500_000
CHUNK = 1 << 12
_NONE = 1 << 60

# Fixed value: how the public byte-level vocabularies split text before merging.
# The white space class is spelled out, since libraries differ on \x1c-\x1f.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(0x100 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


def _latin_split() -> re.Pattern:
    """``SPLIT`` for texts of Latin-1 characters, on which Python's own engine is faster."""

    def ranges(kind: str) -> str:
        held = [c for c in range(256) if unicodedata.category(chr(c))[0] == kind]
        return "".join(re.escape(chr(c)) for c in held)

    letters, numbers = ranges("L"), ranges("N")
    s = r"\t-\r \x85\xa0"
    return re.compile(rf" ?[{letters}]+|'(?:[sdmt]|ll|ve|re)| ?[{numbers}]+| ?[^{s}{letters}{numbers}]+|[{s}]+(?![^{s}])|[{s}]+")


_LATIN = _latin_split()


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % size


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of keys that aren't negative: a slot's key, -1 if free, and value."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    slots, held = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
    at, rest = _slot(keys, size), np.arange(len(keys))
    while len(rest):
        free = slots[at[rest]] < 0
        slots[at[rest[free]]] = keys[rest[free]]  # of several for a slot the last one stays
        won = slots[at[rest]] == keys[rest]
        held[at[rest[won]]] = values[rest[won]]
        rest = rest[~won]
        at[rest] = (at[rest] + 1) % size
    return slots, held


class _Known:
    """Pre-tokens by the hashes of their bytes: where their bytes and their ids stand."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.word = np.zeros(0, np.int64)  # the pre-token of each hash
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.hashes)

    def add(self, hashes: np.ndarray, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers of the new pre-tokens, whose bytes and ids follow each other."""
        numbers = len(self.at) + np.arange(len(hashes))
        put = np.searchsorted(self.hashes, hashes)
        self.hashes, self.word = np.insert(self.hashes, put, hashes), np.insert(self.word, put, numbers)
        self.at, self.size = np.append(self.at, len(self.data) + np.cumsum(sizes) - sizes), np.append(self.size, sizes)
        self.first, self.count = np.append(self.first, len(self.ids) + np.cumsum(counts) - counts), np.append(self.count, counts)
        self.data, self.ids = np.append(self.data, data), np.append(self.ids, ids)
        return numbers


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of the spans of ``size`` from ``first`` on, one span after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class ByteBPE:
    """A byte-level BPE tokenizer read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_id = [vocab[s] for s in symbols]
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.pieces = [b""] * size
        for s, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = _Known()
        self._byte_id = np.array(self.byte_id, np.int64)
        self._made = np.array(self.made, np.int64)
        self._byte_ranks = np.array([[self.merges.get(a << 32 | b, _NONE) for b in self.byte_id] for a in self.byte_id], np.int64).ravel()
        self._slots, self._ranks = _hashed(np.array(list(self.merges), np.int64), np.array(list(self.merges.values()), np.int64))

    def pieces_of(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(text)
        return _LATIN.findall(text)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = _slot(key, len(self._slots))
        held = self._slots[at]
        same = held == key
        out = np.where(same, self._ranks[at], _NONE)
        rest = np.nonzero(~same & (held >= 0) & (key >= 0))
        while len(rest[0]):
            at[rest] = (at[rest] + 1) % len(self._slots)
            held = self._slots[at[rest]]
            found = held == key[rest]
            out[tuple(x[found] for x in rest)] = self._ranks[at[rest][found]]
            rest = tuple(x[~found & (held >= 0)] for x in rest)
        return out

    def _merge_rows(self, ids: np.ndarray, ranks: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Merge the rows in place: ``after`` and ``before`` are each part's neighbours, -1 in ``ids`` a deleted boundary.

        All arrays are [words, width + 1]; the last column stands for no neighbour.
        """
        n, width = ids.shape
        flat_ids, flat_ranks, flat_after, flat_before = (x.reshape(-1) for x in (ids, ranks, after, before))
        base = np.arange(n) * width
        while True:
            at = base + ranks.argmin(1)
            least = flat_ranks[at]
            go = np.flatnonzero(least != _NONE)
            if not len(go) or len(go) < n // 2:
                break
            start, at = base[go], at[go]
            gone = start + flat_after[at]
            beyond, left = flat_after[gone], flat_before[at]
            flat_ids[at] = made = self._made[least[go]]
            flat_ids[gone], flat_ranks[gone] = -1, _NONE
            flat_after[at], flat_before[start + beyond] = beyond, at - start
            # no neighbour has id -2, which is in no pair
            flat_ranks[at] = self._rank(made, flat_ids[start + beyond])
            flat_ranks[start + left] = self._rank(flat_ids[start + left], made)
        if len(go):
            parts = [x[go] for x in (ids, ranks, after, before)]
            self._merge_rows(*parts)
            ids[go] = parts[0]

    def _encode_rows(self, flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode_word`` of the words of ``width`` bytes at most at ``start`` in ``flat``: the ids, and how many of each word."""
        columns = np.arange(width + 1)
        beyond = columns >= sizes[:, None]
        raw = flat[np.minimum(start[:, None] + columns, len(flat) - 1)]
        ids = np.where(beyond, -1, self._byte_id[raw])
        ids[:, width] = -2
        after = np.where(columns + 1 < sizes[:, None], columns + 1, width)
        before = np.broadcast_to(np.where(columns > 0, columns - 1, width), ids.shape).copy()
        ranks = np.full(ids.shape, _NONE, np.int64)
        ranks[:, : width - 1] = np.where(beyond[:, 1:width], _NONE, self._byte_ranks[raw[:, : width - 1].astype(np.int64) << 8 | raw[:, 1:width]])
        self._merge_rows(ids, ranks, after, before)
        held = ids >= 0
        return ids[held].astype(np.uint32), held.sum(1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Encode new pre-tokens together; their numbers in ``known``, in the order given."""
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], [0, *WIDTHS], side="right")
        ids, counts = [], []
        for width, lo, hi in zip(WIDTHS, bounds, bounds[1:]):
            for i in range(lo, hi, CHUNK):
                some = order[i : min(hi, i + CHUNK)]
                x, n = self._encode_rows(data, starts[some], sizes[some], width)
                ids.append(x)
                counts.append(n)
        for k in order[bounds[-1] :]:
            x = np.array(self.encode_word(data[starts[k] : starts[k] + sizes[k]].tobytes()), np.uint32)
            ids.append(x)
            counts.append([len(x)])
        numbers = self.known.add(hashes[order], data[_spread(starts[order], sizes[order])], sizes[order], np.concatenate(ids), np.concatenate(counts))
        out = np.empty(len(order), np.int64)
        out[order] = numbers
        return out

    def _encode_batch(self, texts: list[str], pieces: list[list[str]]) -> Iterator[bytes]:
        """Packed ids of the texts, split into their pre-tokens."""
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        lengths = np.fromiter(map(len, chain.from_iterable(pieces)), np.int64)
        ends = np.cumsum(lengths)
        if len(lengths) and ends[-1] != len(data):  # characters to bytes
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
        hashes = tc.span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]  # a pre-token for each number
        known = self.known
        if len(known) + len(one) > CACHE or len(known.data) > CACHE_BYTES:
            known = self.known = _Known()
        at, there = found_in(known.hashes, hashes[one])
        word = np.where(there, known.word[at] if len(known) else -1, -1)
        old = word[there]
        both, size = np.concatenate((data, known.data)), ends - starts
        spans = np.concatenate((starts, len(data) + known.at)), np.concatenate((ends, len(data) + known.at + known.size))
        same = tc.equal_spans(both, *spans, one[there], len(starts) + old).all() and tc.equal_spans(data, starts, ends, np.arange(len(starts)), one[number]).all()
        if not same:  # different pre-tokens of one hash
            yield from (b"".join(np.array(self.encode_word(p.encode()), "<u4").tobytes() for p in ps) for ps in pieces)
            return
        miss = one[~there]
        if len(miss):
            word[~there] = self._learn(data, starts[miss], size[miss], hashes[miss])
        word = word[number]
        n = known.count[word]
        packed = known.ids[_spread(known.first[word], n)].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64)))] * 4
        for i, j in zip(upto.tolist(), upto[1:].tolist()):
            yield packed[i:j]

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode_packed`` of each text, those of about ``BATCH_CHARS`` characters at a time."""
        held: list[bool] = []
        plain: list[str] = []
        pieces: list[list[str]] = []
        rest: list[bytes] = []
        size = 0

        def flush() -> Iterator[bytes]:
            made, special = self._encode_batch(plain, pieces), iter(rest)
            for is_plain in held:
                yield next(made) if is_plain else next(special)

        for text in texts:
            special = self.at_special is not None and any(s in text for s in self.special)
            held.append(not special)
            if special:
                rest.append(self.encode_packed(text))
            else:
                plain.append(text)
                pieces.append(self.pieces_of(text))
            size += len(text)
            if size >= BATCH_CHARS:
                yield from flush()
                held, plain, pieces, rest, size = [], [], [], [], 0
        yield from flush()

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        rank = self.merges.get
        if len(ids) > LONG:
            return self._encode_long(ids)
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank(ids[x] << 32 | ids[y], _NONE)) != _NONE:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, special strings as their ids."""
        parts = self.at_special.split(text) if self.at_special else [text]
        plain = [p for p in parts if p not in self.special]
        made = self._encode_batch(plain, [self.pieces_of(p) for p in plain])
        return b"".join(struct.pack("<I", self.special[p]) if p in self.special else next(made) for p in parts)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), "<u4")

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One tokenizer for each Python worker."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again, without a shuffle.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with
    ``with_ids``, ids (array<int>) and decoded.  Null texts count as empty: no
    ids, both digests those of no bytes.  Repeated rows each give a row, null
    ids stay null, other columns are not read, an empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, digests, backs, ids, texts = [], [], [], [], []
            for packed in bpe.encode_many(t.as_py() or "" for t in column(batch, text_col)):
                got = np.frombuffer(packed, "<u4")
                back = bpe.decode(got)
                n.append(len(got))
                digests.append(hashlib.sha256(packed).hexdigest())
                backs.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids.append(got.astype(np.int32))
                    texts.append(back)
            out = {id_col: column(batch, id_col), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(backs, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
