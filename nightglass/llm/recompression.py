"""Substring dedup by recompression.

Words are the first symbols.  Each round names the maximal runs of a symbol and
then the pairs (left, right) of neighbours whose coins, bits of their names,
say so.  A name is a fingerprint of the rule that makes it, so all tasks of a
Spark round give equal rules equal names without asking each other, and equal
substrings get equal interior symbols.  With each symbol goes its *context*:
the words that decide it.  A symbol is interior to a window if its context is.

A window of 13 words is represented by one of its interior symbols: that over
the most words, then that with the least name.  Equal windows have equal
interiors and so the same representative, and a stretch of windows shares one.
Symbols that represent windows of one document only are done with.  Shared
ones reveal repeats, whose windows are then compared one by one, by names of
128 bits that are made of the words' own two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightglass.llm import textcore as tc
from nightglass.llm.packed import HOT, RECORDS, Places, by_part, found_in, rows_of, unpacked
from nightglass.llm.packed import shared as shared_records
from nightglass.llm.shared import discard, materialise, scratch

WINDOW, ROUNDS, WIDE = 13, 4, 5
#: Texts are parsed in blocks that fit a processor's own cache; records of so many are packed together.
PARSED_BYTES, PACKED = 1 << 17, 1 << 17
_FAR = 1 << 40
#: In place of a spot: a window that no smaller id can have.
LENT = np.uint32(0xFFFFFFFF)


def parse(words: np.ndarray, edges: np.ndarray, rounds: int = ROUNDS, longest: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Symbols of each round with contexts of ``longest`` words at most: (context start, context end, name).

    ``edges`` are the word offsets at which documents begin, and the end.  What
    a document's edge hides counts as outside any window.
    """
    n = len(words)
    name, a = words, np.arange(n)
    b, left, right = a + 1, a, a + 1
    yield left, right, name
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[edges[:-1]] = True
    ends[edges[1:]] = True
    begins[n] = True
    padded = np.concatenate((words, words[:1]))
    for k in range(rounds):
        # runs; a symbol's neighbours must be seen to differ from it, for which mostly one word does
        same = (name[1:] == name[:-1]) & ~begins[a[1:]]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        last = np.append(first[1:], len(name)) - 1
        count = last - first + 1
        run = np.where(count > 1, tc.mix(name[first] * np.uint64(0x9FB21C651E98DF25) + count.astype(np.uint64)), name[first])
        ra, rb = a[first], b[last]
        rl, rr = np.minimum.reduceat(left, first), np.maximum.reduceat(right, first)
        before, after = np.maximum(ra - 1, 0), np.minimum(rb, n)
        at_begin, at_end = begins[ra], ends[rb]
        alike = padded[before] == padded[b[last] - 1]
        rl = np.where(at_begin, -_FAR, np.minimum(rl, np.where(alike, left[np.maximum(first - 1, 0)], ra - 1)))
        alike = padded[after] == padded[a[first]]
        rr = np.where(at_end, _FAR, np.maximum(rr, np.where(alike, right[np.minimum(last + 1, len(name) - 1)], rb + 1)))
        # pairs of a symbol with coin 0 and a next one with coin 1
        coin = (tc.mix(run + tc.seeds(31, rounds)[k]) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(run), bool)
        joins[:-1] = ~coin[:-1] & coin[1:] & ~at_end[:-1]
        joined = np.concatenate(([False], joins[:-1]))
        # a symbol that stays alone does so because of the neighbour that it might have joined
        nl = np.where(coin & ~joined, np.where(at_begin, -_FAR, np.minimum(rl, np.concatenate(([-_FAR], rl[:-1])))), rl)
        nr = np.where(~coin & ~joins, np.where(at_end, _FAR, np.maximum(rr, np.concatenate((rr[1:], [_FAR])))), rr)
        keep = np.flatnonzero(~joined)
        mate = np.minimum(keep + joins[keep], len(run) - 1)
        pair = joins[keep]
        name = np.where(pair, tc.mix(run[keep] * np.uint64(0xFF51AFD7ED558CCD) + (run[mate] ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xC4CEB9FE1A85EC53)), run[keep])
        a, b = ra[keep], rb[mate]
        left = np.where(pair, np.minimum(rl[keep], rl[mate]), nl[keep])
        right = np.where(pair, np.maximum(rr[keep], rr[mate]), nr[keep])
        fits = right - left <= longest
        yield left[fits], right[fits], name[fits]
        if not fits.any():
            return


def _least_over(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] at each i; positions beyond the end count as the greatest value."""
    out, have = x, 1
    full = np.iinfo(np.uint64).max
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(out, full)
        moved[: len(out) - step] = out[step:]
        out, have = np.minimum(out, moved), have + step
    return out


def representatives(words: np.ndarray, edges: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word position, the name that represents the window starting there.

    The representative is the interior symbol with the widest context, where
    ``WIDE`` words or more count alike, and then the one with the least name; it
    is named by the words of its context, which its equals share.  Positions
    whose window leaves its document hold numbers without meaning.
    """
    n = len(words)
    full = np.iinfo(np.uint64).max
    up, down = tc._POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    by_width: dict[int, np.ndarray] = {}
    for left, right, name in parse(words, edges, longest=window):
        width = right - left
        name = tc.mix((sums[right] - sums[left]) * down[left] ^ tc.mix(name))
        key = (np.uint64(WIDE) - np.minimum(width, WIDE).astype(np.uint64)) << np.uint64(60) | name >> np.uint64(4)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            row = by_width.setdefault(int(w), np.full(n, full, np.uint64))
            np.minimum.at(row, left[at], key[at])
    best = np.full(n, full, np.uint64)
    for w, row in by_width.items():
        best = np.minimum(best, _least_over(row, window - w + 1))
    return best


@dataclass
class Stretches:
    """Maximal runs of windows of one document with one representative."""

    first: np.ndarray  # first window
    last: np.ndarray
    name: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(block: tc.Block, words: np.ndarray, window: int = WINDOW) -> Stretches:
        at = block.word_offsets
        valid = tc.whole_ngrams(at, window)
        start = np.flatnonzero(valid)
        none = np.zeros(0, np.int64)
        if not len(start):
            return Stretches(none, none, np.zeros(0, np.uint64), none)
        best = representatives(words, at, window)[start]
        doc = block.word_doc[start]
        new = np.ones(len(start), bool)
        new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(start)) - 1
        return Stretches(start[head], start[tail], best[head], doc[head])


@dataclass(frozen=True)
class SubstringDedup:
    """``remove_repeats`` with its parameters.

    ``partitions``: the most shuffle partitions, which hold parts of 32 MB of
    text each (0: ``packed.PARTITIONS``).  ``hot``: a name in over this share
    of the map batches is settled on the map side; at most 1 / ``hot`` times
    the names of a batch are, which bounds what is collected of them.
    """

    window: int = WINDOW
    partitions: int = 0
    hot: float = HOT


class _Held:
    """Records (names, ids, spots) gathered until there are enough for a row of each place."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.n += len(part[1])

    def packed(self, places: Places, least: int) -> Iterator[pa.RecordBatch]:
        """A batch if there are ``least`` records, which are then gone; records without a spot make rows of their own."""
        if self.n < least:
            return
        names, ids, spots = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        asks = spots != LENT
        for some, kept in ((asks, spots[asks]), (~asks, None)):
            if some.any():
                yield rows_of(places.of_names(names[some]), names[some], ids[some], kept)


def _greatest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the greatest of its values."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[at], np.maximum.reduceat(values[order], at) if len(at) else values


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _kept_text(data: bytes, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> str:
    """The kept stretches as they stand in the text, a line feed between them."""
    if not kept.any():
        return ""
    head = np.flatnonzero(kept & ~np.concatenate(([False], kept[:-1])))
    tail = np.flatnonzero(kept & ~np.concatenate((kept[1:], [False])))
    return b"\n".join(data[starts[i] : ends[j]] for i, j in zip(head, tail)).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: SubstringDedup = SubstringDedup(), passing: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``how.window`` words that also starts in a document with a smaller id.

    Windows are judged on the input.  Returns ``id_col``, n_words, n_removed,
    kept_sha256 (of the kept words joined by spaces), the ``passing`` columns
    and, with ``with_text``, kept_text: the text where nothing was removed, else
    the kept stretches with a line feed between them.

    ``id_col`` is an integer.  Null and empty texts have no words; rows with a
    null id neither lose words nor cause a loss; rows of one id are one
    document and lose nothing to each other; a text equal to that of a smaller
    id loses all its words if it has a window; other columns are not read, and
    a ``passing`` one with the name of a result column is left out; an empty
    table gives none.
    """
    passing = tuple(c for c in passing if c not in (id_col, "n_words", "n_removed", "kept_sha256", "kept_text"))
    with scratch() as own:
        return _remove_repeats(docs, id_col, text_col, how, passing, with_text, own.keep)


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str, how: SubstringDedup, passing: tuple[str, ...], with_text: bool, keep: Callable) -> DataFrame:
    spark, kind, window = docs.sparkSession, dict(docs.dtypes)[id_col], how.window
    rest = F.struct(*[F.col(c) for c in passing]) if passing else F.lit(None).cast("boolean")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    rest_kind = rows.schema["rest"].dataType.simpleString() if not passing else "struct<" + ",".join(f"`{c}`:{dict(docs.dtypes)[c]}" for c in passing) + ">"
    places = Places.of(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, how.partitions)

    @tc.tidied
    def name_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            ids = tc.column(batch, "id").to_numpy()
            for block in tc.blocks(tc.column(batch, "text"), PARSED_BYTES):
                s = Stretches.of(block, block.word_hashes(), window)
                held.add(s.name[:, None], ids[block.first + s.doc], np.zeros(len(s.name), np.uint32))
                yield from held.packed(places, PACKED)
        yield from held.packed(places, 1)

    some = rows.filter("id IS NOT NULL")
    listed = materialise(some.select("id", "text").mapInArrow(name_stretches, RECORDS), "stretches")
    shared = shared_records(listed, places, "stretches", later="mark", hot=how.hot)
    discard(listed)

    # texts equal to one with a smaller id
    digests = materialise(some.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")).filter("digest IS NOT NULL"), "digests")
    first = materialise(digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last"), "first")
    copies = digests.join(first, "digest").filter("id > first").select("id", F.col("digest").alias("names"))
    at = places.columns(F.col("id"))
    texts = some.withColumns(at | {"ask": F.lit(2)})
    dealt = (
        texts.unionByName(shared.select("place", "sub", "names", "ids", "spots", F.lit(0).alias("ask")), allowMissingColumns=True)
        .unionByName(copies.withColumns(at | {"ask": F.lit(1)}), allowMissingColumns=True)
        .select("place", "sub", "ask", "id", "text", "rest", "names", "ids", "spots")
    )
    result = f"id long, rest {rest_kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    judged = f"{result}, text string, {RECORDS}"

    def arrow_schema(ddl: str, batch: pa.RecordBatch) -> pa.Schema:
        """The schema of ``ddl``'s columns, with the struct of passing columns as it came."""
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
        names = [p.strip().split(" ", 1) for p in ddl.replace(f"rest {rest_kind}", "rest -").split(",")]
        return pa.schema([(c, batch.schema.field("rest").type if c == "rest" else kinds[k]) for c, k in names])

    def finished(block: tc.Block, kept: list[np.ndarray | None], ids: pa.Array, rests: pa.Array, schema: pa.Schema, which: np.ndarray) -> pa.RecordBatch:
        """Result rows of the block's documents ``which``; ``kept`` is None where all words stay."""
        raw = block.data.tobytes()
        at, n_words, removed, digests_, texts_ = block.word_offsets, [], [], [], []
        for i in which:
            s, e = block.starts[at[i] : at[i + 1]], block.ends[at[i] : at[i + 1]]
            k = kept[i]
            words = [raw[x:y] for x, y in (zip(s.tolist(), e.tolist()) if k is None else zip(s[k].tolist(), e[k].tolist()))]
            n_words.append(len(s))
            removed.append(len(s) - len(words))
            digests_.append(_digest(words))
            if with_text:
                texts_.append(raw[block.offsets[i] : block.offsets[i + 1]].decode() if len(s) == len(words) else _kept_text(raw, s, e, k))
        pick = pa.array(which, pa.int64())
        cols = {"id": ids.slice(block.first, block.n).take(pick), "rest": rests.slice(block.first, block.n).take(pick), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests_, pa.string()), "kept_text": pa.array(texts_ if with_text else [None] * len(which), pa.string())}
        return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(len(which), f.type) for f in schema], schema=schema)

    def whole(packed: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for rows_ in packed:
            yield pa.RecordBatch.from_arrays([rows_.column(rows_.schema.get_field_index(f.name)) if f.name in rows_.schema.names else pa.nulls(rows_.num_rows, f.type) for f in schema], schema=schema)

    @tc.tidied
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish documents without shared stretches, and copies; list the shared windows of the others."""
        pairs, copied, held = [], set(), _Held()
        ready = None
        for new, batch in by_part(batches):
            if new:
                pairs, copied, ready = [], set(), None
            schema = arrow_schema(judged, batch)
            ask = tc.column(batch, "ask").to_numpy()
            a, b = np.searchsorted(ask, [1, 2])
            if a:
                names, ids, over = unpacked(batch.slice(0, a), "names", "ids", "spots")
                pairs.append((tc.mix(names[:, 0] ^ tc.mix(ids.view(np.uint64))), over))
            if b > a:
                copied.update(zip(tc.column(batch, "id").slice(a, b - a).to_pylist(), tc.column(batch, "names").slice(a, b - a).to_pylist()))
            if b == batch.num_rows:
                continue
            if ready is None:
                several, over = _greatest(*map(np.concatenate, zip(*pairs))) if pairs else (np.zeros(0, np.uint64),) * 2
                ready, pairs = (several, np.unique(np.array([i for i, _ in copied], np.int64)), over), []
            part = batch.slice(b)
            id_col_, text_col_, rest_col = (tc.column(part, c) for c in ("id", "text", "rest"))
            all_ids = id_col_.to_numpy()
            for block in tc.blocks(text_col_, PARSED_BYTES):
                ids = all_ids[block.first : block.first + block.n]
                words, at = block.word_hashes(), block.word_offsets
                copy = found_in(ready[1], ids)[1]
                for i in np.flatnonzero(copy):  # of the rows of an id only those with the text that an earlier one has
                    copy[i] = (int(ids[i]), hashlib.md5(block.data[block.offsets[i] : block.offsets[i + 1]]).digest()) in copied
                s = Stretches.of(block, words, window)
                place, hit = found_in(ready[0], tc.mix(s.name ^ tc.mix(ids[s.doc].view(np.uint64))))
                hit &= ~copy[s.doc]
                later = np.zeros(len(hit), bool)
                later[hit] = ready[2][place[hit]] > 0
                open_ = np.zeros(block.n, bool)
                open_[s.doc[later]] = True
                long_enough = np.diff(at) >= window
                done = np.flatnonzero(~open_)
                yield finished(block, [np.zeros(at[i + 1] - at[i], bool) if copy[i] and long_enough[i] else None for i in range(block.n)], id_col_, rest_col, schema, done)
                which = np.flatnonzero(open_)
                if len(which):
                    pick = pa.array(which, pa.int64())
                    cols = {"id": id_col_.slice(block.first, block.n).take(pick), "rest": rest_col.slice(block.first, block.n).take(pick), "text": text_col_.slice(block.first, block.n).take(pick)}
                    yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(len(which), f.type) for f in schema], schema=schema)
                if not hit.any():
                    continue
                first_, last_ = s.first[hit], s.last[hit]
                n = last_ - first_ + 1
                starts = np.repeat(first_ - np.cumsum(n) + n, n) + np.arange(n.sum())
                grams = np.stack([tc.ngram_hashes(w, window, k)[starts] for k, w in enumerate((words, block.word_hashes(1)))], axis=1)
                doc = block.word_doc[starts]
                held.add(grams, ids[doc], np.where(np.repeat(later[hit], n), (starts - at[doc]).astype(np.uint32), LENT))
                yield from whole(held.packed(places, PACKED), schema)
        if held.n:
            yield from whole(held.packed(places, 1), schema)

    table = materialise(places.deal(dealt, "ask").mapInArrow(judge, judged), "judged")
    discard(shared, digests, first)
    windows = table.filter("place IS NOT NULL").select("place", "sub", "names", "ids", "spots")
    removed = shared_records(windows, places, "windows", later="only", hot=how.hot, words=2)
    keep(table, removed)
    open_docs = table.filter("text IS NOT NULL").select("id", "text", "rest").withColumns(at | {"ask": F.lit(1)})
    met = open_docs.unionByName(removed.select("place", "sub", "ids", "spots", F.lit(0).alias("ask")), allowMissingColumns=True).select("place", "sub", "ask", "id", "text", "rest", "ids", "spots")

    @tc.tidied
    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, spots_ = [], []
        ready = None
        for new, batch in by_part(batches):
            if new:
                ids_, spots_, ready = [], [], None
            schema = arrow_schema(result, batch)
            b = int(np.searchsorted(tc.column(batch, "ask").to_numpy(), 1))
            if b:
                ids, spots = unpacked(batch.slice(0, b), "ids", "spots")
                ids_.append(ids)
                spots_.append(spots)
            if b == batch.num_rows:
                continue
            if ready is None:
                ids, spots = (np.concatenate(ids_), np.concatenate(spots_)) if ids_ else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
                order = np.argsort(ids, kind="stable")
                ready = ids[order], spots[order]
            part = batch.slice(b)
            id_col_, text_col_, rest_col = (tc.column(part, c) for c in ("id", "text", "rest"))
            all_ids = id_col_.to_numpy()
            for block in tc.blocks(text_col_):
                at, kept = block.word_offsets, []
                for i in range(block.n):
                    lo, hi = np.searchsorted(ready[0], all_ids[block.first + i], "left"), np.searchsorted(ready[0], all_ids[block.first + i], "right")
                    n = int(at[i + 1] - at[i])
                    # rows of one id have one list; a start that another row of it has may not be in this one
                    starts = np.unique(ready[1][lo:hi]).astype(np.int64)
                    kept.append(~tc.covered(starts[starts <= n - window], window, n))
                yield finished(block, kept, id_col_, rest_col, schema, np.arange(block.n))

    @tc.tidied
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = arrow_schema(result, batch)
            for block in tc.blocks(tc.column(batch, "text")):
                yield finished(block, [None] * block.n, tc.column(batch, "id"), tc.column(batch, "rest"), schema, np.arange(block.n))

    names = ["n_words", "n_removed", "kept_sha256"]
    out = table.filter("n_words IS NOT NULL").select("id", "rest", *names, "kept_text").unionByName(places.deal(met, "ask").mapInArrow(take_out, result)).unionByName(rows.filter("id IS NULL").mapInArrow(untouched, result))
    return out.select(F.col("id").cast(kind).alias(id_col), *names, *[F.col(f"rest.`{c}`").alias(c) for c in passing], *(["kept_text"] if with_text else []))
