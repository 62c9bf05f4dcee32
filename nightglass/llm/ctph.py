"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever its low bits are zero, so
a boundary depends on its context alone and survives edits elsewhere.  Each
chunk adds one of 64 letters to the signature.  A fingerprint is
``block:signature:signature at twice the block``, with the least block size
4 * 2**k that cuts the whole text into 64 chunks at most.  Two fingerprints
are compared where they share a block size: the likeness is
2 * LCS / (length + length), which is one less the share of insertions and
deletions in their edit distance, and 0 if they share no run of letters.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightglass.llm import textcore as tc
from nightglass.llm.packed import Places

WINDOW, LETTERS, SMALLEST, RUN = 7, 64, 4, 4
_BYTES = tc.seeds(1, 256)
# Fixed value: the base64 alphabet.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _signature(block: tc.Block, sums: np.ndarray, down: np.ndarray, start: int, ends: np.ndarray, stop: int) -> str:
    ends = ends if len(ends) and ends[-1] == stop else np.append(ends, stop)
    starts = np.concatenate(([start], ends[:-1]))
    hashes = tc.mix((sums[ends] - sums[starts]) * down[starts])
    return ALPHABET[(hashes >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint_block(block: tc.Block) -> list[str]:
    """Fingerprints of a block's documents; ``4::`` for an empty one."""
    data, n = block.data, len(block.data)
    up, down = tc._POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    left = np.maximum(np.arange(n) - (WINDOW - 1), 0)
    head = (block.offsets[:-1, None] + np.arange(WINDOW - 1)).ravel()
    owner = np.repeat(block.offsets[:-1], WINDOW - 1)
    inside = head < np.repeat(block.offsets[1:], WINDOW - 1)
    left[head[inside]] = np.maximum(left[head[inside]], owner[inside])
    rolling = (sums[1:] - sums[left]) * down[left] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    cuts = np.flatnonzero((rolling & np.uint64(SMALLEST - 1)) == 0)
    low = rolling[cuts] >> np.uint64(2)
    level = np.full(len(cuts), 38, np.int64)
    some = low != 0
    level[some] = np.log2((low[some] & (~low[some] + np.uint64(1))).astype(np.float64)).astype(np.int64)
    ends, at = cuts + 1, np.searchsorted(cuts, block.offsets)
    out = []
    for i in range(block.n):
        start, stop = int(block.offsets[i]), int(block.offsets[i + 1])
        if start == stop:
            out.append(f"{SMALLEST}::")
            continue
        lv, en = level[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]
        counts = len(lv) - np.concatenate(([0], np.cumsum(np.bincount(lv, minlength=40))))  # cuts of level >= k
        k = int(np.argmax(counts < LETTERS))
        first = _signature(block, sums, down, start, en[lv >= k], stop)
        second = _signature(block, sums, down, start, en[lv > k], stop)
        out.append(f"{SMALLEST << k}:{first}:{second}")
    return out


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _similar(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(RUN, max(1, min(len(a), len(b)) // 2))
    held = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in held for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * _lcs(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where the block sizes aren't compatible."""
    if x == y:
        return 1.0
    (p, a, aa), (q, b, bb) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_similar(a, b), _similar(aa, bb))
    if p == 2 * q:
        return _similar(a, bb)
    return _similar(aa, b) if q == 2 * p else 0.0


def fingerprints(texts: list[str]) -> list[str]:
    return [x for block in tc.blocks(pa.array(texts, pa.large_string())) for x in fingerprint_block(block)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars and fingerprint of each whole text, without a shuffle.

    Null texts count as empty.  Repeated rows each give a row, null ids stay
    null, other columns are not read, an empty table gives none.
    """

    @tc.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tc.column(batch, id_col)
            for block in tc.blocks(tc.column(batch, text_col)):
                chars = np.diff(block.chars[block.offsets])
                yield pa.RecordBatch.from_pydict({id_col: ids.slice(block.first, block.n), "n_chars": pa.array(chars, pa.int64()), "fingerprint": pa.array(fingerprint_block(block), pa.string())})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_chars long, fingerprint string")


def _bucket(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most ``key``: two levels, so that a row is compared with about 2 * sqrt(n) bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    coarse = F.array(*map(F.lit, bounds[::step]))
    blocks = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
    top = below(coarse)
    return F.coalesce(F.when(key.isNull() | (top == 0), 0).otherwise((top - 1) * step + below(F.get(blocks, top - 1))), F.lit(0)).cast("int")


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _ranges(rows: DataFrame, buckets: int | None) -> tuple[Column, int, list]:
    """Of rows of (id, tie): the number of the range that a row goes to, how many ranges there are, and the ids that fill more than one.

    Ranges are of ascending (id, tie), nulls first.  Their bounds are quantiles
    of the ids; an id, or the nulls, that fills several is parted by tie.
    """
    n = buckets or Places.of(rows.sparkSession, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0).partitions
    marks = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("id", marks, 100 * n).alias("b") if marks else F.array().alias("b"), F.count("id").alias("some"), F.count(F.lit(1)).alias("every")).first()
    shares = Counter(found["b"] or [])
    bounds = sorted(shares)
    nulls = n * (found["every"] - found["some"]) // max(1, found["every"])
    parts = [max(1, nulls), *(shares[b] for b in bounds)]  # of the nulls, and of each bound's id
    first = [0, *accumulate(parts)]
    key, j = F.col("id"), _bucket(F.col("id"), bounds)
    hot = ([None] if nulls > 1 else []) + [b for b in bounds if shares[b] > 1]
    if not hot:
        return j, len(parts), hot
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), j)
    whole = key.isNull() if not bounds else F.when(j == 0, key.isNull()).otherwise(F.coalesce(key == F.get(F.array(*map(F.lit, bounds)), j - 1), F.lit(False)))
    by_tie = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * at(parts)), at(parts) - 1)
    return (at(first[:-1]) + F.when(whole, by_tie).otherwise(at(parts) - 1)).cast("int"), first[-1], hot


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint each text and its edited text, and compare it with both and with the next document.

    The edited text has its last floor(n_chars/2) code points replaced by the
    first as many (or all) of the next document in ascending ``id_col``; the
    first document follows the last.  Texts cross the network once: rows go
    to ranges of ids, and the first document of each range also to the range
    before it.  There are as many ranges as the bytes ask for, and the driver
    holds a bound and a head for each.

    ``id_col`` is numeric.  Null texts count as empty; null ids come first;
    rows with equal ids are ordered by text hash, so that repeated rows follow
    each other; an id that fills several ranges is parted by text hash, and its
    equal rows are counted first and dealt out at the end; a single document
    follows itself; an empty table gives none.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    bucket, n, hot = _ranges(rows, buckets)
    if hot:
        is_hot = F.col("id").isin([h for h in hot if h is not None]) | (F.col("id").isNull() if None in hot else F.lit(False))
        is_hot = F.coalesce(is_hot, F.lit(False))
        rows = rows.filter(~is_hot).withColumn("copies", F.lit(1).cast("long")).unionByName(rows.filter(is_hot).groupBy("id", "text", "tie").agg(F.count(F.lit(1)).alias("copies")))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    keyed = rows.withColumn("bucket", bucket)
    firsts = keyed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "tie")).alias("m")).orderBy("bucket").collect()
    heads = [(firsts[i]["bucket"], firsts[i]["m"]["id"], firsts[i]["m"]["tie"], firsts[i - 1]["bucket"]) for i in range(len(firsts))]
    heads_df = F.broadcast(spark.createDataFrame(heads, f"bucket int, head {kind}, head_tie long, before int"))  # a row a bucket
    is_head = (heads_df["head"].eqNullSafe(keyed["id"])) & (heads_df["head_tie"] == keyed["tie"])
    own, before = F.struct("bucket", F.lit(False).alias("follows")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("follows"))
    dealt = (
        keyed.join(heads_df, (keyed["bucket"] == heads_df["bucket"]) & is_head, "left")
        .select(keyed["bucket"], "id", "tie", "text", "copies", "before")
        .select(F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, before))).alias("to"), "id", "tie", "text", "copies")
        .select("to.bucket", "to.follows", "id", "tie", "text", "copies")
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", "follows", F.col("id").asc_nulls_first(), "tie")
    )
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long"

    @tc.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (bucket, id, text), not followers, still without their next

        def answer(pairs: list[tuple]) -> pa.RecordBatch:
            texts = [t for _, t, _, _ in pairs]
            edits = [_edited(t, after) for _, t, after, _ in pairs]
            afters = [after for _, _, after, _ in pairs]
            own, edit = fingerprints(texts), fingerprints(edits)
            # each next text but the last is the following pair's own text
            nexts = [own[k + 1] if k + 1 < len(pairs) and afters[k] is texts[k + 1] else None for k in range(len(pairs))]
            missing = [k for k, x in enumerate(nexts) if x is None]
            for k, x in zip(missing, fingerprints([afters[k] for k in missing])):
                nexts[k] = x
            return pa.RecordBatch.from_pydict(
                {
                    id_col: pa.array([i for i, _, _, _ in pairs], id_type),
                    "n_chars": pa.array(list(map(len, texts)), pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
                    "fingerprint": pa.array(own, pa.string()),
                    "edited_fingerprint": pa.array(edit, pa.string()),
                    "near_edited": pa.array([likeness(a, b) for a, b in zip(own, edit)], pa.float64()),
                    "near_next": pa.array([likeness(a, b) for a, b in zip(own, nexts)], pa.float64()),
                    "times": pa.array([n for _, _, _, n in pairs], pa.int64()),
                }
            )

        id_type = None
        for batch in batches:
            id_type = tc.column(batch, "id").type
            pairs: list[tuple] = []
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for bucket, follows, i, text, copies in zip(*(tc.column(part, c).to_pylist() for c in ("bucket", "follows", "id", "text", "copies"))):
                    if held and held[0][0] == bucket:
                        pairs.append((held[0][1], held[0][2], text, 1))
                        held.clear()
                    if not follows:
                        if copies > 1:  # each but the last is followed by another
                            pairs.append((i, text, text, copies - 1))
                        held.append((bucket, i, text))
                if pairs:
                    yield answer(pairs)
                    pairs = []

    out = dealt.mapInArrow(run, schema)
    if hot:  # in two steps, so that no list is long
        step = 1 << 16
        out = out.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / step))))
        out = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step), F.col("times") - F.col("_of") * step)))).drop("_of", "_k")
    return out.drop("times")
