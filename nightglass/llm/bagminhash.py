"""MinHash near-dedup: weighted-Jaccard signatures by BagMinHash, bands, and exact verification.

A document is the multiset of its five-word shingles.  Weights are discretised
at the integers; the level ranges [0,1), [1,2), [2,4), [4,8), ... of a shingle
each have a Poisson process with a point's component, and its level inside the
range, drawn by halving from the point's hash.  A point counts if its level is
below the shingle's weight, so the processes of a smaller weight are parts of
those of a greater one, and component i of two signatures agrees with
probability sum(min) / sum(max).  Points come in ascending order and a process
stops once it is beyond the signature's largest component, which for most
shingles is at its first or second point.

Bands of the signature name buckets.  Each bucket links its members to its
least one, so that a group of n gives n - 1 pairs; every pair is verified on
the whole multisets.  Buckets that then still hold several classes give pairs
between their classes: first of one member each, then of all members whose
overlap may be large enough.  The overlap of two documents is at most the sum,
over ``PARTS`` parts of the shingles, of the lesser of their numbers of
shingles there that another document in question has too.  Two documents of a
bucket that this leaves out can't be similar, and others that are never
compared are already joined through a third.  The members of a bucket of over
``HOT_BUCKET`` such ones are dealt anew by their rarest shingles, so many that
any two similar ones have one of them in common, and those that share one are
compared.  The members that share a shingle, if they are over ``HOT_BUCKET``
too, are put into chunks, and every two chunks are compared by themselves, but
for those whose sizes, bounds or classes rule out all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightglass.llm import textcore as tc
from nightglass.llm.packed import RECORDS, Places, by_part, found_in, rows_of, shared, unpacked
from nightglass.llm.shared import discard, materialise, scratch

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 5
SIGNATURE_BLOCK = 1 << 20
#: Text of the pairs that are compared together.
VERIFY_BYTES = 4 << 20
PARTS = 32
#: Four parts of 16 bits go into one column; texts of so many shingles have no bound.
_PACKS, _UNBOUND = [f"p{k}" for k in range(PARTS // 4)], 65_535
#: Members that one copy of their head's text is sent along with.
WITH_HEAD = 200
#: Members of different classes in one bucket that one task compares; more are compared by chunks.
HOT_BUCKET = 1000
#: Members of one key that are sent together.
CHUNK = 8192
#: Counts of shingles, by hash, that every worker holds.
SLOTS = 1 << 18
#: Bits of a bitmap of ids, which is broadcast in words of 64.
BITMAP = 1 << 26


def bags(block: tc.Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of a block, each shingle once a document, in document order.

    A document with fewer words than ``size``, but some, has one shingle of all of them.
    """
    words, at = block.word_hashes(), block.word_offsets
    n = np.diff(at)
    grams = tc.ngram_hashes(words, size)
    whole = np.flatnonzero(tc.whole_ngrams(at, size))
    doc, gram = block.word_doc[whole], grams[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = tc.mix(np.array([(words[at[i] : at[i + 1]] * tc.seeds(17, int(n[i]))).sum() for i in short], np.uint64) + n[short].astype(np.uint64))
        doc, gram = np.concatenate((doc, short)), np.concatenate((gram, own))
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    first = np.flatnonzero(new)
    return doc[first], gram[first], np.diff(np.append(first, len(doc)))


def signatures(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """[n, m] signatures of the bags; inf for an empty bag."""
    out = np.full(n * m, np.inf)
    # the level ranges that each shingle needs: number k covers [2**(k-1), 2**k), number 0 [0, 1)
    need = np.where(weight <= 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1)
    row = np.repeat(np.arange(len(doc)), need)
    level = np.arange(len(row)) - np.repeat(np.cumsum(need) - need, need)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    span = np.maximum(low, 1)
    own, room, key = doc[row], weight[row] - low, tc.mix(gram[row] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    x, t = np.zeros(len(row)), 0
    total = np.bincount(own, minlength=n)
    while len(row):
        take = int(np.clip(200_000 // len(row), 2, 64))
        steps = (np.arange(t + 1, t + take + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        r = tc.mix(key[:, None] + steps)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * span)[:, None]
        at = x[:, None] + np.cumsum(gap, axis=1)
        r = tc.mix(r ^ np.uint64(0xD1B54A32D192ED03))
        component = ((r >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        inside = ((r & np.uint64(0xFFFFFFFF)) * span.astype(np.uint64)[:, None] >> np.uint64(32)).astype(np.int64) < room[:, None]
        slot = own[:, None] * m + component
        useful = inside & (at < out[slot])
        np.minimum.at(out, slot[useful], at[useful])
        x, t = at[:, -1], t + take
        go = x < out.reshape(n, m).max(1)[own]
        row, own, room, key, span, x = row[go], own[go], room[go], key[go], span[go], x[go]
    out = out.reshape(n, m)
    out[total == 0] = np.inf
    return out


def band_names(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[n, bands] 64-bit bucket names."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    seeds = tc.seeds(23, bands * rows).reshape(bands, rows) | np.uint64(1)
    return tc.mix((tc.mix(bits) * seeds).sum(2, dtype=np.uint64) + tc.seeds(29, bands)).astype(np.uint64)


def near_heads(head: tuple, member: tuple, n: int, threshold: float) -> np.ndarray:
    """Whether each of ``n`` members has the weighted Jaccard similarity with its head; two empty bags have 1.

    ``head``: (group, gram, weight) of the heads' bags; ``member``: (member,
    gram, weight, group of each member).
    """
    group, gram, weight = head
    doc, gram_m, weight_m, group_m = member
    key = lambda g, k: tc.mix(g ^ tc.mix(k.astype(np.uint64)))
    keys = key(gram, group)
    order = np.argsort(keys)
    at, there = found_in(keys[order], key(gram_m, group_m[doc]))
    if len(order):
        at = order[at]
        there &= (gram[at] == gram_m) & (group[at] == group_m[doc])
    least = np.bincount(doc[there], weights=np.minimum(weight_m[there], weight[at[there]]), minlength=n)
    sizes = np.bincount(group, weights=weight, minlength=int(group_m.max(initial=0)) + 1)
    most = np.bincount(doc, weights=weight_m, minlength=n) + sizes[group_m] - least
    return np.where(most > 0, least / np.maximum(most, 1), 1.0) >= threshold


@dataclass(frozen=True)
class NearDedup:
    """``near_duplicates`` with its parameters."""

    threshold: float = SIMILARITY
    bands: int = BANDS
    rows: int = ROWS
    size: int = SHINGLE
    star_rounds: int = 4

    def sketch(self, docs: DataFrame) -> DataFrame:
        """id, digest of the text, number of shingles, and band names of each row of (id, text)."""

        @tc.tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = tc.column(batch, "id"), tc.column(batch, "text")
                for block in tc.blocks(texts, SIGNATURE_BLOCK):
                    doc, gram, weight = bags(block, self.size)
                    names = band_names(signatures(doc, gram, weight, block.n, self.bands * self.rows), self.bands, self.rows)
                    n = np.bincount(doc, weights=weight, minlength=block.n).astype(np.int64)
                    flat = pa.array(names.view(np.int64).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * self.bands), flat)
                    yield pa.RecordBatch.from_pydict({"id": ids.slice(block.first, block.n), "n": pa.array(n), "buckets": lists, "digest": tc.column(batch, "digest").slice(block.first, block.n)})

        kind = dict(docs.dtypes)["id"]
        return docs.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))).mapInArrow(run, f"id {kind}, n long, buckets array<long>, digest binary")

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar; ``texts`` (id, text) has every id of them once.

        The members ``b`` of a head ``a`` stream by beside it, so that its text
        is sent once for ``WITH_HEAD`` of them.
        """
        kind = dict(texts.dtypes)["id"]
        salts = F.ceil(F.count(F.lit(1)) / WITH_HEAD).cast("int").alias("salts")
        of_head = pairs.groupBy("a").agg(salts)
        heads = of_head.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast(kind).alias("b"), F.col("a").alias("id"))
        salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
        members = pairs.join(of_head.filter("salts > 1"), "a", "left").select("a", salt, "b", F.col("b").alias("id"))
        dealt = heads.unionByName(members).join(texts, "id").select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

        @tc.tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, np.int64)
            carried = none, np.zeros(0, np.uint64), none  # the bag of the head whose members go on
            for batch in batches:
                is_head = np.asarray(tc.column(batch, "b").is_null())
                for block in tc.blocks(tc.column(batch, "text"), VERIFY_BYTES):
                    doc, gram, weight = bags(block, self.size)
                    first = is_head[block.first : block.first + block.n]
                    group = np.cumsum(first)
                    own = first[doc]
                    head = [np.concatenate((c, x[own])) for c, x in zip(carried, (group[doc], gram, weight))]
                    number = np.cumsum(~first) - 1
                    members = np.flatnonzero(~first)
                    near = near_heads(tuple(head), (number[doc[~own]], gram[~own], weight[~own], group[members]), len(members), self.threshold)
                    pick = pa.array(block.first + members[near], pa.int64())
                    if len(pick):
                        yield pa.RecordBatch.from_pydict({"a": tc.column(batch, "a").take(pick), "b": tc.column(batch, "b").take(pick)})
                    last = head[0] == group[-1]
                    carried = np.zeros(int(last.sum()), np.int64), head[1][last], head[2][last]

        return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def overlap_bounds(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, held, p0, p1, ...): how many shingles, in all and by part, four to a column, each text has that another of ``texts`` has too.

    Those without any are left out.  Shingles are packed for the shuffle, and
    combined before it, as in ``packed.shared``.
    """
    places = Places.of(texts.sparkSession, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    @tc.tidied
    def list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tc.column(batch, "id").to_numpy()
            for block in tc.blocks(tc.column(batch, "text")):
                doc, gram, weight = bags(block, size)
                if len(doc):
                    yield rows_of(places.of_names(gram[:, None]), gram[:, None], ids[block.first + doc], weight.astype(np.uint32))

    @tc.tidied
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def added() -> pa.RecordBatch:
            names, ids, weights = (np.concatenate(x) for x in zip(*held))
            every, row = np.unique(ids, return_inverse=True)
            sums = np.bincount(row * PARTS + (tc.mix(names[:, 0]) % np.uint64(PARTS)).astype(np.int64), weights=weights, minlength=len(every) * PARTS).astype(np.int64).reshape(-1, PARTS)
            packs = np.minimum(sums, _UNBOUND).astype("<u2").view("<i8")
            return pa.RecordBatch.from_pydict({"id": pa.array(every), "held": pa.array(sums.sum(1))} | {p: pa.array(packs[:, k]) for k, p in enumerate(_PACKS)})

        for new, batch in by_part(batches):
            if new and held:
                yield added()
                held.clear()
            held.append(unpacked(batch, "names", "ids", "spots"))
        if held:
            yield added()

    with scratch() as own:
        listed = materialise(texts.select("id", "text").mapInArrow(list_shingles, RECORDS), "shingles")
        common = shared(listed, places, "shingles")
        discard(listed)
        out = materialise(places.deal(common).mapInArrow(add_up, ", ".join(["id long", "held long", *(f"{p} long" for p in _PACKS)])), "bounds")
        own.keep(out)
        return out


def may_be_near(threshold: float, x: str, y: str) -> str:
    """SQL: sizes and overlap bounds of the aliases ``x`` and ``y`` allow the similarity."""
    need = f"({threshold / (1 + threshold)!r} * ({x}.n + {y}.n) - 1e-6)"
    packs = lambda t: f"array({', '.join(f'{t}.{p}' for p in _PACKS)})"
    four = " + ".join(f"least(shiftright(p, {16 * k}) & {_UNBOUND}, shiftright(q, {16 * k}) & {_UNBOUND})" for k in range(4))
    # a part of 65,535 or more is cut, which is no matter unless both texts may have one
    return f"least({x}.held, {y}.held) >= {need} AND (least({x}.n, {y}.n) >= {_UNBOUND} OR aggregate(zip_with({packs(x)}, {packs(y)}, (p, q) -> {four}), 0L, (s, v) -> s + v) >= {need})"


_MEMBER = ["key", "id", "class", "n", "held", *_PACKS]


def _near_members(x: np.ndarray, y: np.ndarray, threshold: float, within: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): the pairs between the rows ``x`` and ``y`` of ``_MEMBER`` of different classes that ``may_be_near``; ``within``: both are the same rows."""
    ids, classes_, n, held = y[:, 1], y[:, 2], y[:, 3], y[:, 4]
    parts, parts_x = (np.ascontiguousarray(z[:, 5:]).view("<u2") for z in (y, x))
    for i in range(0, len(x), 32):
        own = x[i : i + 32]
        need = threshold / (1 + threshold) * (own[:, 3, None] + n) - 1e-6
        apart = own[:, 2, None] < classes_ if within else own[:, 2, None] != classes_
        a, b = np.nonzero(apart & (np.minimum(own[:, 4, None], held) >= need))
        keep = []
        for k in range(0, len(a), 65_536):
            r, c = a[k : k + 65_536], b[k : k + 65_536]
            overlap = np.minimum(parts_x[i + r], parts[c]).sum(1, dtype=np.int64)
            keep.append((overlap >= need[r, c]) | (np.minimum(own[r, 3], n[c]) >= _UNBOUND))
        if keep and len(near := np.flatnonzero(np.concatenate(keep))):
            one, two = own[a[near], 1], ids[b[near]]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})


def _by_key(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[np.ndarray]:
    """The rows of each key, of rows of ``_MEMBER`` sorted by it; a key of over ``most`` in several parts."""
    carried: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([tc.column(batch, c).to_numpy() for c in _MEMBER], axis=1)
        cuts = [0, *(np.flatnonzero(np.diff(rows[:, 0])) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if carried and (carried[0][0, 0] != rows[lo, 0] or most and sum(map(len, carried)) >= most):
                    yield np.concatenate(carried)
                    carried = []
                carried.append(rows[lo:hi])
    if carried:
        yield np.concatenate(carried)


def pairs_within(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of members (key, id, class, n, held, p0, ...) of one key and different classes that ``may_be_near``.

    A key's members are held together, so the caller bounds their number.
    """

    @tc.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            yield from _near_members(rows, rows, threshold, True)

    return members.select(*_MEMBER).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def pairs_across(members: DataFrame, threshold: float) -> DataFrame:
    """``pairs_within`` for keys of any number of members.

    A key's members are cut into chunks by number of shingles, those of a
    class of a chunk or more apart from the others.  Every two chunks of a key
    are one row of work, unless both are of one class, or the bounds of one
    allow none of the other's sizes.  Only figures of chunks are joined in
    pairs by key; the members are sent as often as their chunk is compared.
    """
    chunk, share = CHUNK, threshold / (1 + threshold)

    @tc.tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 32 * chunk):
            order = np.lexsort((rows[:, 3], rows[:, 2]))
            _, at, count = np.unique(rows[order, 2], return_index=True, return_counts=True)
            large = [order[i : i + c] for i, c in zip(at, count) if c >= chunk]
            rest = np.setdiff1d(np.arange(len(rows)), np.concatenate(large)) if large else np.arange(len(rows))
            for some in (*large, rest[np.argsort(rows[rest, 3], kind="stable")]):
                for i in range(0, len(some), chunk):
                    own = rows[some[i : i + chunk]]
                    # the greatest number of shingles that another may have
                    reach = ((own[:, 4] + 1e-3) / share - own[:, 3]).max()
                    figures = {"key": own[0, 0], "first": own[0, 1], "low": own[:, 2].min(), "high": own[:, 2].max(), "least": own[:, 3].min()}
                    yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.int64()) for c, v in figures.items()} | {"reach": pa.array([reach]), "rows": pa.array([own.tobytes()], pa.binary())})

    @tc.tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, same in zip(tc.column(batch, "one"), tc.column(batch, "two"), tc.column(batch, "same").to_pylist()):
                x, y = (np.frombuffer(z.as_buffer(), np.int64).reshape(-1, len(_MEMBER)) for z in (one, two))
                yield from _near_members(x, y, threshold, same)

    with scratch() as own:
        dealt = members.select(*_MEMBER).repartitionByRange("key", "class", "id").sortWithinPartitions("key", "class")  # a large key is dealt to several tasks
        chunks = materialise(dealt.mapInArrow(cut, "key long, first long, low long, high long, least long, reach double, rows binary"), "chunks")
        own.keep(chunks)
    figures = chunks.drop("rows")
    allowed = "x.key = y.key AND x.first <= y.first AND x.reach >= y.least AND y.reach >= x.least AND NOT (x.low = x.high AND y.low = y.high AND x.low = y.low)"
    # rows of work are small and much to do, so they are dealt to all tasks
    work = figures.alias("x").join(figures.alias("y"), F.expr(allowed)).selectExpr("x.key", "x.first AS f1", "y.first AS f2").repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "f1", "f2")
    held = lambda first, rows: chunks.select("key", F.col("first").alias(first), F.col("rows").alias(rows))
    return work.join(held("f1", "one"), ["key", "f1"]).join(held("f2", "two"), ["key", "f2"]).select("one", "two", F.expr("f1 = f2").alias("same")).mapInArrow(compare, "a long, b long")


def rare_shingles(texts: DataFrame, threshold: float, size: int = SHINGLE) -> DataFrame:
    """(key, id): the rarest shingles of each of ``texts`` (id, text), so many that two similar texts have one in common; further columns stay.

    The shingles of all texts have one order, by how many texts have one of
    their slot.  Texts of the similarity have at least that share of either
    one's weight in common, so that the first common shingle comes, in both,
    before the weight that is left has fallen below that share.  Slots of one
    text have no common shingle and are left out.
    """
    slot = lambda gram: (tc.mix(gram) % np.uint64(SLOTS)).astype(np.int64)
    kinds = {c: t for c, t in texts.dtypes if c != "text"}

    @tc.tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for block in tc.blocks(tc.column(batch, "text")):
                held += np.bincount(slot(bags(block, size)[1]), minlength=SLOTS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some), "n": pa.array(held[some])})

    counts = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()

    @tc.tidied
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tc.blocks(tc.column(batch, "text")):
                doc, gram, weight = bags(block, size)
                order = np.lexsort((gram, often[slot(gram)], doc))
                doc, gram, weight = doc[order], gram[order], weight[order]
                total = np.bincount(doc, weights=weight, minlength=block.n)
                ends = np.cumsum(total)
                before = np.cumsum(weight) - weight - (ends - total)[doc]
                pick = (before <= (total - np.ceil(threshold * total - 1e-6))[doc]) & (often[slot(gram)] > 1)
                row = pa.array(block.first + doc[pick], pa.int64())
                yield pa.RecordBatch.from_pydict({"key": pa.array(gram[pick].view(np.int64))} | {c: tc.column(batch, c).take(row) for c in kinds})

    return texts.mapInArrow(rarest, ", ".join(["key long", *(f"{c} {t}" for c, t in kinds.items())]))


def components(edges: DataFrame) -> DataFrame:
    """(id, class): each end of ``edges`` (a, b) with the least id that it is connected with.

    Each round hangs every node under its least neighbour, shortens the chains
    until all are under roots, and contracts the edges to the roots; the edges
    left fall at least by half, so the rounds grow as the logarithm of a class.
    """
    with scratch() as own:
        edges, labels = materialise(edges.select("a", "b"), "edges"), None
        while not edges.isEmpty():
            both = edges.union(edges.select("b", "a"))
            up = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "up")
            moved = True
            while moved:
                above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
                higher = materialise(up.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
                moved = not higher.filter("moved").isEmpty()
                discard(up)
                up = higher
            if labels is None:
                labels = materialise(up.select("id", F.col("up").alias("class")), "labels")
            else:
                labels, old = _relabelled(labels, up.select("id", F.col("up").alias("class"))), labels
                discard(old)
            root_a, root_b = up.select(F.col("id").alias("a"), F.col("up").alias("ra")), up.select(F.col("id").alias("b"), F.col("up").alias("rb"))
            left = materialise(edges.join(root_a, "a").join(root_b, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
            discard(edges, up)
            edges = left
        if labels is None:
            labels = materialise(edges.select(F.col("a").alias("id"), F.col("b").alias("class")), "labels")
        own.keep(labels)
        return labels


def _relabelled(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``labels`` with its classes put into ``classes`` (id, class) of some of them."""
    further = classes.select(F.col("id").alias("class"), F.col("class").alias("top"))
    return materialise(labels.join(further, "class", "left").select("id", F.coalesce("top", "class").alias("class")), "labels")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (id, class) after the edges ``more`` between its ids or new ones; only classes are contracted anew."""
    with scratch() as own:
        root = lambda end: labels.select(F.col("id").alias(end), F.col("class").alias(f"r{end}"))
        ends = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        classes = components(ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        known = _relabelled(labels, classes)
        out = materialise(known.unionByName(classes.join(labels, "id", "left_anti")), "labels")
        own.keep(out)
        return out


def by_bitmap(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be among ``ids`` (id), and those whose key isn't, without a shuffle of rows.

    A bit of ``BITMAP`` is set for each id, so that what is broadcast is
    bounded at any number of them; with very many the first part has most rows.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITMAP))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot(c), F.lit(64)).cast("int"))
    word, mask = (next(f"{n}{k or ''}" for k in range(len(rows.columns) + 1) if f"{n}{k or ''}" not in rows.columns) for n in ("word", "mask"))
    words = F.broadcast(ids.select(F.shiftright(slot("id"), 6).alias(word), bit("id").alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask)))  # at most BITMAP / 64 rows
    met = rows.withColumn(word, F.shiftright(slot(key), 6)).join(words, word, "left")
    held = F.coalesce(F.col(mask).bitwiseAND(bit(key)) != 0, F.lit(False))
    return met.filter(held).select(*rows.columns), met.filter(~held).select(*rows.columns)


def _several(members: DataFrame, *key: str) -> DataFrame:
    """The members of keys with several classes, with the least one as ``low``."""
    classes = members.groupBy(*key).agg(F.min("class").alias("low"), F.max("class").alias("high"))
    with scratch() as own:
        open_ = materialise(classes.filter("low != high").select(*key, "low"), "several")
        out = materialise(members.join(open_, list(key)), "apart")
        own.keep(out)
        return out


def _pairs_left(apart: DataFrame, texts: DataFrame, bounds: DataFrame, how: NearDedup) -> DataFrame:
    """(a, b): all pairs of members of different classes in a bucket that may be similar; a task holds a bounded number of members."""
    keyed = apart.withColumnRenamed("bucket", "key")
    few, many = _hot(keyed)
    out = pairs_within(_bounded(few, bounds), how.threshold)
    if many is None:
        return out
    open_ = materialise(many.select("id", "class").distinct(), "open")
    rare = materialise(rare_shingles(texts.join(open_, "id"), how.threshold, how.size), "rare")
    dealt = _several(rare, "key")
    discard(rare, open_)
    few, often = _hot(dealt)
    found = pairs_within(_bounded(few, bounds), how.threshold)
    if often is not None:
        found = found.union(pairs_across(_bounded(often, bounds), how.threshold))
    found = materialise(found.distinct(), "found")
    end = lambda name: many.select(F.col("id").alias(name), "key")
    return out.union(found.join(end("a"), "a").join(end("b"), ["b", "key"]).select("a", "b"))


def _bounded(members: DataFrame, bounds: DataFrame) -> DataFrame:
    """The members (key, id, class) with their ``bounds``, which meet an id once, not once for each key of it."""
    of_id = members.groupBy("id").agg(F.min("class").alias("class"), F.collect_list("key").alias("keys"))
    return of_id.join(bounds, "id").withColumn("key", F.explode("keys")).drop("keys")


def _hot(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The members of keys of ``HOT_BUCKET`` at most, and those of the others, if there are any."""
    hot = materialise(members.groupBy("key").count().filter(f"count > {HOT_BUCKET}").select("key"), "hot")
    if hot.isEmpty():
        return members, None
    return members.join(hot, "key", "left_anti"), members.join(hot, "key", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: NearDedup = NearDedup()) -> DataFrame:
    """The class of each row: the least id among the documents that it is joined with.

    Rows with equal texts are of one class, as are documents whose shingle
    multisets have a weighted Jaccard similarity of ``how.threshold`` or more,
    and those joined through others.  ``id_col`` is an integer.  Returns it and
    class_id, a row for each row.  Null and empty texts are equal, and near only to each
    other and to texts of white space; rows of one id count as one document,
    whose text is that with the least MD5 digest; rows with a null id have a
    null class and take no part; other columns are not read; an empty table
    gives none.
    """
    with scratch() as own:
        return _near_duplicates(docs, id_col, text_col, how, own.keep)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, how: NearDedup, keep: Callable) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = rows.filter("id IS NOT NULL")
    sketches = materialise(how.sketch(some), "sketches")
    twice = materialise(sketches.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("last")).filter("digest != last").select("id", F.col("digest").alias("own")), "twice")
    several = not twice.isEmpty()
    if several:  # ids with different texts
        sketched = sketches.join(twice, "id", "left").filter("own IS NULL OR digest = own")
        some = some.join(twice, "id", "left").filter("own IS NULL OR own = unhex(md5(cast(text AS binary)))").select("id", "text")
    else:
        sketched = sketches
    # exact copies first: one document stands for each text
    firsts = materialise(sketched.groupBy("digest").agg(F.min(F.struct("id", "n", "buckets")).alias("m")).select("digest", "m.*"), "firsts")
    named = firsts.select("id", "n", F.explode("buckets").alias("bucket"))
    # aggregates are written before they are joined to what they were made from, so that Spark can split a hot bucket's join
    heads = materialise(named.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head != last").select("bucket", "head"), "heads")
    members = materialise(named.join(heads, "bucket").select("bucket", "id", "n", "head"), "members")
    discard(heads)
    asked = materialise(members.select("id").distinct(), "asked")
    texts = materialise(by_bitmap(some, "id", asked)[0].join(asked, "id", "left_semi").dropDuplicates(["id"]), "texts")
    discard(asked)
    pairs = materialise(members.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    edges = materialise(how.verify(pairs, texts), "near")
    discard(pairs)
    classes = components(edges)
    discard(edges)
    apart, bounds, by_class = None, None, None
    near = may_be_near(how.threshold, "x", "y")
    for k in range(how.star_rounds + 1):
        # what buckets still hold of several classes
        before = members if apart is None else apart
        held = before.drop("head", "class", "low").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
        left = _several(held, "bucket")
        discard(before)
        if bounds is None and not left.isEmpty():
            shared_ = overlap_bounds(texts.join(left.select("id").distinct(), "id", "left_semi"), how.size)
            bounds = materialise(left.select("id", "n").distinct().join(shared_, "id").filter(f"held >= {how.threshold} * n - 1e-6"), "bounds")
            hopeful = materialise(left.select("bucket", "id", "class").join(bounds.select("id"), "id", "left_semi"), "apart")
            discard(left, shared_)
            left = _several(hopeful, "bucket")
            discard(hopeful)
        apart = left
        size = apart.count()
        if not size:
            break
        last = k == how.star_rounds or by_class is not None and by_class < 0.01 * size
        if not last:
            # one member of each class, another one each round, against one of the bucket's least class
            picks = apart.groupBy("bucket", "class").agg(F.min_by("id", F.xxhash64("id", "bucket", F.lit(k))).alias("id"), F.min("low").alias("low")).join(bounds, "id")
            tried = picks.filter("class != low").alias("x").join(picks.filter("class = low").alias("y"), F.expr(f"x.bucket = y.bucket AND {near}")).selectExpr("least(x.id, y.id) AS a", "greatest(x.id, y.id) AS b")
        else:
            tried = _pairs_left(apart, texts, bounds, how)
        tried = materialise(tried.distinct(), "pairs")
        more = materialise(how.verify(tried, texts), "near")
        by_class = more.count()
        if by_class:
            classes, old = joined(classes, more), classes
            discard(old)
        discard(tried, more)
        if last:
            break
    of_text = firsts.select("digest", F.col("id").alias("first")).join(classes.withColumnRenamed("id", "first"), "first", "left").select("digest", F.coalesce("class", "first").alias("class_id"))
    own = sketches.select("id", "digest")
    if several:
        own = own.join(twice, "id", "left").select("id", F.coalesce("own", "digest").alias("digest"))
        keep(twice)
    found = own.join(of_text, "digest").select("id", "class_id")
    keep(sketches, firsts, classes)
    kind = dict(docs.dtypes)[id_col]
    every = found.unionByName(rows.filter("id IS NULL").select("id", F.col("id").alias("class_id")))
    return every.select(F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: NearDedup = NearDedup()) -> DataFrame:
    """``docs`` with one document of each class: that with the least id; rows with a null id stay.

    Of several rows of that id the one stays whose text has the least MD5
    digest, and of those the one with the least hash of its other columns.
    Most documents stay where they are: only those that a bitmap of the ids in
    question has are shuffled.
    """
    with scratch() as own:
        found = near_duplicates(docs, id_col, text_col, how).select(F.col(id_col).alias("id"), "class_id").filter("id IS NOT NULL")
        rows = found.groupBy("id").agg(F.min("class_id").alias("class"), F.count(F.lit(1)).alias("rows"))
        marked = materialise(rows.filter("class != id OR rows > 1").select("id", (F.col("class") == F.col("id")).alias("stays")), "marked")
        own.keep(marked)
    mark = next(f"marked{k or ''}" for k in range(len(docs.columns) + 1) if f"marked{k or ''}" not in docs.columns)
    asked, others = by_bitmap(docs.filter(F.col(id_col).isNotNull()), id_col, marked)
    of = lambda some, kind: asked.join(some.select(F.col("id").alias(mark)), F.col(id_col) == F.col(mark), kind)
    out = others.unionByName(of(marked, "left_anti"))
    stays = marked.filter("stays")
    if not stays.isEmpty():
        order = F.struct(F.md5(F.coalesce(text_col, F.lit("")).cast("binary")), F.xxhash64(*(c for c, t in docs.dtypes if "map" not in t)))
        out = out.unionByName(of(stays, "left_semi").groupBy(F.col(id_col).alias(mark)).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*"))
    return out.unionByName(docs.filter(F.col(id_col).isNull()))
