"""Best-fit packing of tokenised documents into sequences, as vector bin packing.

A sequence has three capacities: tokens, documents and attention cost (the sum
of its pieces' squared lengths).  Pieces go, longest first, into the open
sequences whose residual vector after placing has the least weighted norm (or
the greatest weighted dot product with the piece), under every constraint.

Pieces of one length are alike, so the packing is planned on the *histogram* of
lengths, at most ``tokens`` numbers at any size of corpus: sequences with the
same content are one group with a count.  The plan gives every length ranges of
slots; each piece's rank among its length, from salted windows, picks its slot.
One global packing results, and only ids, lengths and checksums cross the network.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightglass.llm import bpe
from nightglass.llm.shared import materialise, scratch
from nightglass.llm.textcore import column, tidied


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most; 0 documents or attention: no limit beside the tokens'."""

    tokens: int = 2048
    documents: int = 0
    attention: int = 0
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05)
    rule: str = "norm"

    @property
    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)

    def longest(self) -> int:
        """The longest piece that an empty sequence takes."""
        return min(self.tokens, int(self.limits[2] ** 0.5))


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal sequences: ([(length, copies), ...], number of sequences).

    ``counts`` has the pieces of each length.  The work depends on the number
    of lengths, not of pieces.
    """
    limits = capacity.limits
    scale = np.sqrt(np.array(capacity.weights)) / limits
    left = np.zeros((64, 3), np.int64)  # residuals of the groups
    many = np.zeros(64, np.int64)
    holds: list[list[tuple[int, int]]] = []

    def add(residual: np.ndarray, n: int, content: list[tuple[int, int]]) -> None:
        nonlocal left, many
        if len(holds) == len(many):
            left, many = np.concatenate((left, np.zeros_like(left))), np.concatenate((many, np.zeros_like(many)))
        left[len(holds)], many[len(holds)] = residual, n
        holds.append(content)

    for length in sorted(counts, reverse=True):
        rest, need = counts[length], np.array([length, 1, length * length], np.int64)
        while rest:
            k = len(holds)
            fits = np.flatnonzero((many[:k] > 0) & (left[:k] >= need).all(1))
            if len(fits):
                if capacity.rule == "dot":
                    best = fits[np.argmax((left[fits] * scale) @ (need * scale))]
                else:
                    best = fits[np.argmin((((left[fits] - need) * scale) ** 2).sum(1))]
                have, free, content = int(many[best]), left[best].copy(), holds[best]
            else:
                best, have, free, content = -1, rest, limits.copy(), []
            copies = min(rest, int((free // need).min()))
            bins = min(have, rest // copies)
            if best >= 0:
                many[best] -= bins
            add(free - copies * need, bins, [*content, (length, copies)])
            rest -= bins * copies
    return [(h, int(n)) for h, n in zip(holds, many) if n]


@dataclass
class Slots:
    """For each length, ascending ranges of ranks: where they start, and the sequences, copies and offset they map to."""

    first: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    copies: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @staticmethod
    def of(groups: list[tuple[list[tuple[int, int]], int]]) -> Slots:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for content, n in groups:
            offset = 0
            for length, copies in content:
                rows.setdefault(length, []).append((used.get(length, 0), base, copies, offset))
                used[length] = used.get(length, 0) + n * copies
                offset += length * copies
            base += n
        cols = [{k: np.array([r[j] for r in v], np.int64) for k, v in rows.items()} for j in range(4)]
        return Slots(*cols)

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of one length by their ranks."""
        k = np.searchsorted(self.first[length], ranks, side="right") - 1
        slot = ranks - self.first[length][k]
        copies = self.copies[length][k]
        return self.base[length][k] + slot // copies, self.offset[length][k] + slot % copies * length


def tokenised_pieces(docs: DataFrame, path: str, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut only if longer than a sequence.

    The pieces of a longer one are full, but that the first may be shorter.
    """
    longest = capacity.longest()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tail = bpe.load(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, packed in enumerate(tokenizer.encode_many(t.as_py() or "" for t in column(batch, text_col))):
                packed += tail
                n = len(packed) // 4
                at = 0
                for k in range(-(-n // longest)):
                    size = (n - 1) % longest + 1 if not k else longest
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(packed[4 * at : 4 * (at + size)]))
                    at += size
            ids = column(batch, id_col).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_pydict({id_col: ids, "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def assign(pieces: DataFrame, capacity: Capacity = Capacity(), id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a table of pieces (which is read three times, so it should be materialised)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row a length
    slots = Slots.of(plan(counts, capacity))
    # lengths with many pieces are salted, so that no window holds more than a few times a task's share
    share = max(1000, sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // share)) for k, n in counts.items()], "length long, _salts long"))  # a row a length
    dealt = pieces.join(salts, "length", "left").withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("_salts"))).drop("_salts")
    sizes = sorted((r["length"], r["_salt"], r["count"]) for r in dealt.groupBy("length", "_salt").count().collect())  # lengths + 4 a task, at most
    before: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for length, salt, n in sizes:
        before[length, salt] = seen.get(length, 0)
        seen[length] = before[length, salt] + n
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("ids_crc32", id_col, "piece")).cast("long") - 1)
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    schema = f"`{id_col}` {dict(pieces.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (column(batch, c).to_numpy() for c in ("length", "_salt", "_rank"))
            rank = rank + np.array([before[k] for k in zip(length.tolist(), salt.tolist())], np.int64)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(some):
                    sequence[some], offset[some] = slots.place(int(length[some[0]]), rank[some])
            yield pa.RecordBatch.from_pydict({c: column(batch, c) for c in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: a row for each piece with its sequence and offset.

    Null and empty texts are the end id alone.  Repeated rows are packed each;
    null ids stay null; other columns are not read; an empty table gives no
    rows.  Ties in length are broken by checksum, id and piece.
    """
    with scratch() as own:
        pieces = materialise(tokenised_pieces(docs, path, capacity, id_col, text_col), "pieces")
        own.keep(pieces)
        return assign(pieces, capacity, id_col)
