"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over every position, and overlapping
chunks (``CHUNK`` bytes, a new one each ``BLOCK``) that cover the whole document
are max-pooled to a vector each.  The chunks' mean and maximum, side by side, go
through one logistic unit to a probability.  Training samples at most
``TRAIN_ROWS`` labelled rows; it reads all chunks of each, as scoring does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightglass.llm import textcore as tc

TRAIN_ROWS = 2000
STEP_CHUNKS = 512
BLOCK, CHUNK, WIDTH, DIMS, FILTERS, PAD = 128, 256, 6, 4, 16, 256


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes with each document filled up to whole blocks (one at least), and the documents' first blocks."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate(([0], np.cumsum(counts)))
    codes = np.full(int(first[-1]) * BLOCK, PAD, np.uint16)
    codes[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes)] = data
    return codes, first


@dataclass
class ByteCnn:
    """embed [257, DIMS] (the last row, padding, is 0), filters [WIDTH * DIMS, FILTERS], bias, and the last unit."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @staticmethod
    def new(seed: int = 3) -> ByteCnn:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (257, DIMS)).astype(np.float32)
        embed[PAD] = 0
        return ByteCnn(embed, r.normal(0, 0.4, (WIDTH * DIMS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """[positions, WIDTH * DIMS]: each position's embedded window."""
        flat = np.concatenate((self.embed[codes].ravel(), np.zeros((WIDTH - 1) * DIMS, np.float32)))
        return np.lib.stride_tricks.as_strided(flat, (len(codes), WIDTH * DIMS), (DIMS * 4, 4)).copy()

    def block_maxima(self, codes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """[blocks, FILTERS]: the filters' maxima over each block, through ReLU.

        A window reaches into the next block, but for the ``last`` blocks of
        documents, where padding stands beyond.
        """
        out = np.empty((len(codes) // BLOCK, FILTERS), np.float32)
        step = 512
        for i in range(0, len(out), step):
            part = codes[i * BLOCK : (i + step) * BLOCK + WIDTH - 1]
            n = min(step, len(out) - i) * BLOCK
            seen = self.windows(part)[:n]
            ends = (np.flatnonzero(last[i : i + step]) + 1) * BLOCK
            for k in range(1, WIDTH):
                seen[ends - k, k * DIMS :] = 0
            out[i : i + step] = (seen @ self.filters).reshape(-1, BLOCK, FILTERS).max(1)
        return np.maximum(out + self.bias, 0)

    def score_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the documents between ``offsets``."""
        codes, first = _padded(data, offsets)
        last = np.zeros(int(first[-1]), bool)
        last[first[1:] - 1] = True
        top = self.block_maxima(codes, last)
        # a chunk is a block and the next one of its document; a single block is a chunk
        chunk = np.where(last[:, None], top, np.maximum(top, np.roll(top, -1, 0)))
        keep = ~last
        keep[first[:-1][np.diff(first) == 1]] = True
        n = np.maximum(1, np.diff(first) - 1)
        chunk = np.where(keep[:, None], chunk, 0)
        mean = np.add.reduceat(chunk.astype(np.float64), first[:-1], axis=0) / n[:, None]
        most = np.maximum.reduceat(chunk, first[:-1], axis=0)
        z = np.hstack((mean, most)) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], epochs: int = 30, batch: int = 64, rate: float = 0.04, seed: int = 5) -> ByteCnn:
    """Train by Adam, whose rate falls to nothing, through the max-pooling; the same rows in the same order give the same model.

    With one label only, or no rows, the result is a constant: the share of
    label 1, with one row added of each label.
    """
    net, r = ByteCnn.new(), np.random.default_rng(seed)
    positive = (sum(labels) + 1) / (len(labels) + 2)
    net.out_bias = float(np.log(positive / (1 - positive)))
    if len(set(labels)) < 2:
        return net
    coded, size, alone = [], [], []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        blocks = max(1, -(-len(raw) // BLOCK))
        codes = np.full(max(2, blocks) * BLOCK, PAD, np.uint16)
        codes[: len(raw)] = raw
        coded.append(codes)
        size.append(max(1, blocks - 1))
        alone.append(blocks == 1)
    size, alone, y = np.array(size), np.array(alone), np.array(labels, np.float32)
    reach = np.arange(WIDTH)
    params = {k: getattr(net, k) for k in ("embed", "filters", "bias", "out")} | {"out_bias": np.array([net.out_bias])}
    m1, m2 = ({k: np.zeros(v.shape) for k, v in params.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            counts = size[docs]
            edge = np.concatenate(([0], np.cumsum(counts)))[:-1]
            which = np.repeat(np.arange(len(docs)), counts)
            data = np.concatenate([coded[d] for d in docs])
            base = np.concatenate(([0], np.cumsum([len(coded[d]) for d in docs])))[:-1]
            start = np.concatenate([b + BLOCK * np.arange(n) for b, n in zip(base, counts)])
            best = np.empty((len(start), FILTERS), np.int64)
            value = np.empty((len(start), FILTERS), np.float32)
            for i in range(0, len(start), STEP_CHUNKS):
                codes = data[start[i : i + STEP_CHUNKS, None] + np.arange(CHUNK)]
                # as in scoring, a chunk's last windows reach into the next block, or into padding at the text's end
                after = start[i : i + STEP_CHUNKS, None] + CHUNK + np.arange(WIDTH - 1)
                inside = after < (base + [len(coded[d]) for d in docs])[which[i : i + STEP_CHUNKS], None]
                codes = np.hstack((codes, np.where(inside, data[np.minimum(after, len(data) - 1)], PAD)))
                seen = (net.windows(codes.ravel()) @ params["filters"]).reshape(len(codes), CHUNK + WIDTH - 1, FILTERS)[:, :CHUNK]
                seen[alone[docs][which[i : i + STEP_CHUNKS]], BLOCK:] = -np.inf  # a single block is the whole chunk
                best[i : i + STEP_CHUNKS] = at = seen.argmax(1)
                value[i : i + STEP_CHUNKS] = np.take_along_axis(seen, at[:, None], 1)[:, 0] + params["bias"]
            chunk = np.maximum(value, 0)
            mean = np.add.reduceat(chunk, edge, axis=0) / counts[:, None]
            most = np.maximum.reduceat(chunk, edge, axis=0)
            z = np.hstack((mean, most)) @ params["out"] + params["out_bias"]
            gz = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[docs]) / len(docs)
            g = {"out": np.hstack((mean, most)).T @ gz + 1e-4 * params["out"], "out_bias": np.array([gz.sum()])}
            gc = gz[which, None] * params["out"][:FILTERS] / counts[which, None] + gz[which, None] * params["out"][FILTERS:] * (chunk == most[which])
            gc = np.where(value > 0, gc, 0.01 * gc).astype(np.float32)  # a leak, in training only, revives idle filters
            g["bias"] = gc.sum(0)
            g["filters"], ge = np.zeros((WIDTH, DIMS, FILTERS)), np.zeros((257, DIMS))
            limit = (base + [len(coded[d]) for d in docs])[which]
            by_filter = params["filters"].reshape(WIDTH, DIMS, FILTERS)
            for i in range(0, len(start), STEP_CHUNKS):
                part = slice(i, i + STEP_CHUNKS)
                where = start[part, None, None] + best[part, :, None] + reach
                near = np.where(where < limit[part, None, None], data[np.minimum(where, len(data) - 1)], PAD)  # [chunks, FILTERS, WIDTH]
                g["filters"] += np.einsum("cfwd,cf->wdf", params["embed"][near], gc[part])
                push = np.einsum("wdf,cf->cfwd", by_filter, gc[part]).reshape(-1, DIMS)
                for d in range(DIMS):
                    ge[:, d] += np.bincount(near.ravel(), push[:, d], 257)
            g["filters"] = g["filters"].reshape(WIDTH * DIMS, FILTERS)
            ge[PAD] = 0
            g["embed"] = ge
            step += 1
            for k, p in params.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                p -= (rate * (1 - step / (steps + 1)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    net.out_bias = float(params["out_bias"][0])
    return net


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> ByteCnn:
    """Fit on the ``rows`` labelled rows, not held out, with the least id hashes, half of either label where there are as many.

    The sample, beside the labels' counts, is all that reaches the driver; its
    ids are broadcast.  Of several labels of an id the least counts, and of
    several rows the text with the least MD5 digest, so that the same tables
    always give the same model.  The last bias is then moved from the sample's
    odds to those of all labelled rows, so that scores are probabilities among
    them.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    ids = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows // 2).collect()]
    if not ids:
        return fit([], [])
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, known.schema))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(chosen, "id")
    found = texts.groupBy("id", "y").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")).collect()
    found.sort(key=lambda r: r["id"])
    net = fit([r["text"] for r in found], [r["y"] for r in found])
    every = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    sample = [sum(r["y"] == y for r in found) for y in (0, 1)]
    if all(sample):
        net.out_bias += float(np.log(every[1] / every[0]) - np.log(sample[1] / sample[0]))
    return net


def score_quality(docs: DataFrame, net: ByteCnn, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.3, passing: tuple[str, ...] = ()) -> DataFrame:
    """Score each whole text, without a shuffle.

    Returns ``id_col``, the ``passing`` columns unchanged (but for any named
    score or predicted, which are left out), score (0 to 1, higher: label 1
    likelier) and predicted (1 if score >= ``keep``).  Null and
    empty texts get the score of one block of padding.  Repeated rows each give
    a row, null ids stay null, other columns are not read, an empty table gives
    none.
    """
    kinds = dict(docs.dtypes)
    held = [id_col, *(c for c in passing if c not in (id_col, "score", "predicted"))]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in held) + ", score double, predicted int"
    names = list(dict.fromkeys([*held, text_col]))

    @tc.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tc.blocks(tc.column(batch, text_col)):
                scores = net.score_block(block.data, block.offsets)
                yield pa.RecordBatch.from_pydict({c: tc.column(batch, c).slice(block.first, block.n) for c in held} | {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= keep).astype(np.int32))})

    return docs.select(*names).mapInArrow(run, schema)
