"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, in numpy over blocks of
whole documents, mark the n-grams that a document holds twice or more; the
characters inside them, and inside lines equal to an earlier one, are measured
against the characters of all words.  What two hashes say is equal is compared,
bytes with bytes, before it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightglass.llm import textcore as tc

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """A document fails if a share of its words' characters, in percent, is over its limit."""

    min_words: int = 50
    max_repeat_words: float = 50.0
    ngrams: tuple[tuple[int, float], ...] = ((5, 40.0), (10, 30.0))
    max_dup_line_chars: float = 50.0


def _salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a document."""
    return tc.mix(hashes ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _repeated(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the thing occurs again anywhere; it occurred at an earlier position.

    Equal things have equal keys; ``same`` says whether those of two positions
    are equal, and ``exact`` makes keys that only equal ones share, for the case
    that it finds others.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    alike = keys[order][1:] == keys[order][:-1]
    if not same(order[1:][alike], order[:-1][alike]).all():
        return _repeated(exact(), lambda a, b: np.ones(len(a), bool), exact)
    again, earlier = np.zeros(n, bool), np.zeros(n, bool)
    again[order[1:][alike]] = True
    again[order[:-1][alike]] = True
    earlier[order[1:][alike]] = True
    return again, earlier


def _numbered(things: Iterator) -> np.ndarray:
    known: dict = {}
    return np.array([known.setdefault(t, len(known)) for t in things], np.int64)


def measure(block: tc.Block, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of ``repetition_rules`` for a block's documents."""
    n, words, doc = block.n, block.word_hashes(), block.word_doc
    sums = lambda x, at: np.add.reduceat(np.append(x, 0), at[:-1]) * (np.diff(at) > 0)
    at, data = block.word_offsets, block.data
    chars = block.chars[block.ends] - block.chars[block.starts]
    out = {"n_words": np.diff(at), "word_chars": sums(chars, at)}
    out["n_symbols"] = np.diff(np.concatenate(([0], np.cumsum(_SYMBOL[data])))[block.offsets])

    def inside(size: int) -> np.ndarray:
        hashes = tc.ngram_hashes(words, size)
        if not len(hashes):
            return np.zeros(len(words), bool)
        whole = np.flatnonzero(tc.whole_ngrams(at, size))

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b, numbers = whole[a], whole[b], block.word_numbers
            return np.logical_and.reduce([doc[a] == doc[b], *(numbers[a + k] == numbers[b + k] for k in range(size))])

        again, _ = _repeated(_salted(hashes[whole], doc[whole]), same, lambda: _numbered((doc[i], *block.word_numbers[i : i + size]) for i in whole))
        return tc.covered(whole[again], size, len(words))

    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(np.append(breaks + 1, 0), block.offsets[:-1])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
    line_ends = line_ends - (data[line_ends - 1] == 10)
    first = np.searchsorted(block.starts, line_starts)
    after = np.searchsorted(block.starts, line_ends)
    kept = np.flatnonzero(after > first)
    line_doc, begin, stop = block.per_doc(line_starts[kept]), line_starts[kept], line_ends[kept]
    _, earlier = _repeated(
        _salted(tc.span_hashes(data, begin, stop), line_doc),
        lambda a, b: (line_doc[a] == line_doc[b]) & tc.equal_spans(data, begin, stop, a, b),
        lambda: _numbered((d, data[i:j].tobytes()) for d, i, j in zip(line_doc, begin, stop)),
    )
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=n)
    run = np.concatenate(([0], np.cumsum(chars)))
    dup_line_chars = np.bincount(line_doc[earlier], weights=(run[after[kept]] - run[first[kept]])[earlier], minlength=n)

    out["n_repeat_words"] = sums(inside(3).astype(np.int64), at)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words * out["n_words"])
    verdict = ~out["base_failed"]
    for size, limit in rules.ngrams:
        held = sums(np.where(inside(size), chars, 0), at)
        out[f"dup_{size}gram_chars"] = held
        verdict &= 100 * held <= limit * out["word_chars"]
    out["dup_line_chars"] = dup_line_chars.astype(np.int64)
    verdict &= 100 * dup_line_chars <= rules.max_dup_line_chars * out["word_chars"]
    out["kept"] = verdict
    return out


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """Measure each whole text's repetition and judge it, without a shuffle.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept (boolean), and the characters in
    duplicated n-grams and lines.  Null and empty texts have no words and fail.
    Repeated rows each give a row, null ids stay null, other columns are not
    read, an empty table gives none.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = [*(f"dup_{size}gram_chars" for size, _ in rules.ngrams), "dup_line_chars"]
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} long" for c in extra)

    @tc.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tc.column(batch, id_col)
            for block in tc.blocks(tc.column(batch, text_col)):
                found = measure(block, rules)
                cols = {c: pa.array(found[c], pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in [*counts, "base_failed", "kept", *extra]}
                yield pa.RecordBatch.from_pydict({id_col: ids.slice(block.first, block.n)} | cols)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
