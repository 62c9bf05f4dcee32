"""Records of (name, id) by the million, packed into binary columns for the shuffle.

A row holds the records of one batch that go to one place, so that a shuffle
moves 8 bytes a name (or 16) and 8 an id before compression, and numpy works on
whole columns of them.

A place is a shuffle partition and a part of it (``sub``).  There are as many
places as the bytes ask for, but at most ``PARTITIONS`` partitions; a task
sorts its rows by part and holds one part's records at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightglass.llm import textcore as tc
from nightglass.llm.shared import discard, materialise, scratch

#: A name in over this share of the map batches is settled on the map side: at most 1 / HOT times the names of a batch are.
HOT = 0.02
#: Names in so few batches are never hot.
LEAST_HOT = 16
#: Text whose names and documents one place takes.
PLACE_BYTES = 32 << 20
#: The most partitions of a shuffle.
PARTITIONS = 16_384


@dataclass(frozen=True)
class Places:
    """``partitions`` shuffle partitions of ``subs`` parts each."""

    partitions: int
    subs: int = 1

    @staticmethod
    def of(spark: SparkSession, size: int, most: int = 0) -> Places:
        """For ``size`` bytes of text."""
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PLACE_BYTES))
        partitions = min(wanted, most or PARTITIONS)
        return Places(partitions, -(-wanted // partitions))

    def of_names(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = names[:, 0]
        return (first % np.uint64(self.partitions)).astype(np.int32), (first // np.uint64(self.partitions) % np.uint64(self.subs)).astype(np.int32)

    def of_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``columns`` is the same for a column."""
        x = ids ^ (ids >> 17)
        place = x % self.partitions
        return place.astype(np.int32), ((x - place) // self.partitions % self.subs).astype(np.int32)

    def columns(self, key: Column) -> dict[str, Column]:
        x = key.bitwiseXOR(F.shiftright(key, 17))
        place = F.pmod(x, F.lit(self.partitions))
        return {"place": place.cast("int"), "sub": F.pmod(F.call_function("div", x - place, F.lit(self.partitions)), F.lit(self.subs)).cast("int")}

    def deal(self, rows: DataFrame, *order: str) -> DataFrame:
        """Rows at their places, sorted by part and then ``order``."""
        return rows.repartitionById(self.partitions, F.col("place")).sortWithinPartitions("sub", *order)


RECORDS = "place int, sub int, names binary, ids binary, spots binary"


def rows_of(where: tuple[np.ndarray, np.ndarray], names: np.ndarray | None, ids: np.ndarray, spots: np.ndarray | None) -> pa.RecordBatch:
    """Records as a row for each place, packed; ``names`` is [records, 1 or 2 words]; what isn't given is null."""
    place, sub = where
    order = np.lexsort((sub, place)) if sub.any() else np.argsort(place, kind="stable")
    place, sub, ids = place[order], sub[order], ids[order]
    at = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(sub, prepend=-1) != 0))
    cuts = list(zip(at, np.append(at[1:], len(ids))))
    cut = lambda x: pa.nulls(len(at), pa.binary()) if x is None else pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary())
    pick = lambda x: None if x is None else x[order]
    return pa.RecordBatch.from_pydict({"place": pa.array(place[at], pa.int32()), "sub": pa.array(sub[at], pa.int32()), "names": cut(pick(names)), "ids": cut(ids), "spots": cut(pick(spots))})


def unpacked(batch: pa.RecordBatch, *columns: str, words: int = 1) -> list[np.ndarray]:
    kinds = {"names": np.uint64, "ids": np.int64, "spots": np.uint32}
    out = [np.frombuffer(b"".join(tc.column(batch, c).to_pylist()), kinds[c]) for c in columns]
    return [x.reshape(-1, words) if c == "names" else x for c, x in zip(columns, out)]


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new part begins, rows of one part) of rows sorted by part."""
    now = None
    for batch in batches:
        sub = tc.column(batch, "sub").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sub)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield now != sub[lo], batch.slice(lo, hi - lo)
                now = sub[lo]


def _order(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal names together by their first words, and where a new name begins in it."""
    order = np.argsort(names[:, 0])
    held = names[order]
    new = np.ones(len(order), bool)
    new[1:] = (held[1:] != held[:-1]).any(1)
    if names.shape[1] > 1 and (new[1:] & (held[1:, 0] == held[:-1, 0])).any():  # names that differ in the second word only
        order = np.lexsort(names.T[::-1])
        held = names[order]
        new[1:] = (held[1:] != held[:-1]).any(1)
    return order, new


def _combined(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each name once, with its least and greatest id and the number of its records."""
    order, new = _order(names)
    at, ids = np.flatnonzero(new), ids[order]
    if not len(at):
        return names, ids, ids, at
    return names[order[at]], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at), np.diff(np.append(at, len(ids)))


def found_in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def found_names(table: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``found_in`` for names of one or two words; the table is sorted by the first."""
    at, there = found_in(table[:, 0], names[:, 0])
    if names.shape[1] == 1 or not there.any():
        return at, there
    rest = np.flatnonzero(there & (table[at, 1] != names[:, 1]))
    while len(rest):  # the next one with that first word
        at[rest] += 1
        inside = at[rest] < len(table)
        there[rest] = False
        rest = rest[inside]
        rest = rest[table[at[rest], 0] == names[rest, 0]]
        there[rest] = table[at[rest], 1] == names[rest, 1]
        rest = rest[~there[rest]]
    return np.minimum(at, len(table) - 1), there


def shared(records: DataFrame, places: Places, name: str, later: str = "", hot: float = HOT, words: int = 1) -> DataFrame:
    """Of the records (place, sub, names, ids, spots), placed by name: those whose name several ids have, placed by id.

    ``later``: "mark" puts 1 for spots where the id is over the name's least,
    and 0 elsewhere; "only" leaves the others out, and the names.  Rows without
    spots only lend their names and ids.  Names are of ``words`` 64-bit words.  They are combined to their least and greatest id
    in each map batch before they are shuffled.  The names that several ids
    have are then looked up by the records as they stream by, so that no task
    holds the records of a name together.
    """

    @tc.tidied
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, least, most, _ = _combined(*unpacked(batch, "names", "ids", words=words))
            two = np.flatnonzero(least != most)
            everything = np.concatenate((names, names[two]))
            yield rows_of(places.of_names(everything), everything, np.concatenate((least, most[two])), None)
            yield pa.RecordBatch.from_pydict({"place": pa.array([-1], pa.int32()), "sub": pa.array([0], pa.int32()), "names": [b""], "ids": [b""], "spots": [b""]})

    @tc.tidied
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            names, least, most, counts = _combined(*(np.concatenate(x) for x in zip(*held)))
            many = least != most
            if many.any():
                yield rows_of(places.of_names(names[many]), names[many], least[many], counts[many].astype(np.uint32))

        for new, batch in by_part(batches):
            if new and held:
                yield from settled()
                held.clear()
            held.append(unpacked(batch, "names", "ids", words=words))
        if held:
            yield from settled()

    with scratch() as own:
        sent = materialise(records.mapInArrow(combine, RECORDS), f"{name}-sent")
        batches_made = sent.filter("place < 0").count()
        known = materialise(places.deal(sent.filter("place >= 0")).mapInArrow(settle, RECORDS), f"{name}-known")
        discard(sent)
        bound = max(LEAST_HOT, int(hot * batches_made))

        @tc.tidied
        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, ids, counts = unpacked(batch, "names", "ids", "spots", words=words)
                some = np.flatnonzero(counts > 2 * bound)
                if len(some):
                    yield pa.RecordBatch.from_pydict({"name": pa.array([names[k].tobytes() for k in some], pa.binary()), "least": pa.array(ids[some])})

        rows = known.mapInArrow(frequent, "name binary, least long").collect()  # at most 1 / hot times a batch's names
        hot_names = np.frombuffer(b"".join(bytes(r["name"]) for r in rows), np.uint64).reshape(-1, words)
        order = np.argsort(hot_names[:, 0])
        hot_names, hot_least = hot_names[order], np.array([r["least"] for r in rows], np.int64)[order]

        def wanted(batch: pa.RecordBatch, table: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            names, ids, spots = unpacked(batch, "names", "ids", "spots", words=words)
            at, there = found_names(table, names)
            if later and len(table):
                over = ids > least[at]
                there &= over | (later != "only")
                spots = over.astype(np.uint32) if later == "mark" else spots
            if there.any():
                yield rows_of(places.of_ids(ids[there]), None if later == "only" else names[there], ids[there], spots[there])

        @tc.tidied
        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from wanted(batch, hot_names, hot_least)

        @tc.tidied
        def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, ids, spots = unpacked(batch, "names", "ids", "spots", words=words)
                rest = ~found_names(hot_names, names)[1]
                yield rows_of(places.of_names(names[rest]), names[rest], ids[rest], spots[rest])

        @tc.tidied
        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros((0, words), np.uint64), np.zeros(0, np.int64)
            table, least = none
            held: list[list[np.ndarray]] = []
            for new, batch in by_part(batches):
                if new:
                    (table, least), held = none, []
                ask = tc.column(batch, "ask").to_numpy(zero_copy_only=False).astype(bool)
                first = int(np.searchsorted(ask, True))
                if first:
                    held.append(unpacked(batch.slice(0, first), "names", "ids", words=words))
                if first < batch.num_rows:
                    if held:
                        names, ids = (np.concatenate(x) for x in zip(*held))
                        order = np.argsort(names[:, 0])
                        table, least, held = names[order], ids[order], []
                    yield from wanted(batch.slice(first), table, least)

        asking = records.filter("spots IS NOT NULL")
        asked = asking.mapInArrow(cold, RECORDS) if len(hot_names) else asking
        both = known.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)))
        out = places.deal(both, "ask").mapInArrow(look_up, RECORDS)
        if len(hot_names):
            out = out.unionByName(asking.mapInArrow(direct, RECORDS))
        out = materialise(out, f"{name}-shared")
        own.keep(out)
        return out
