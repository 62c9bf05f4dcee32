"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates, for each end position, all vocabulary
pieces that end there, longest first.  Dynamic programming carries the best
score and the number of pieces, and no back pointers.  The tie rule is the
tokenizer's: among equal scores the piece that starts first stays, a character
without a piece of its own may also be unknown at the least score less 10, and
unknown characters count as their UTF-8 bytes (byte fallback).

Text is normalised as the vocabulary's own tokenizer does: a space in front,
then spaces become U+2581.  No piece runs from another character into U+2581
(checked when the vocabulary is loaded; else texts stay whole), so the lattice
falls apart there without any change of score, count or tie, and the parts'
counts are cached, in a cache emptied at ``CACHE`` entries and at a task's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from nightglass.llm.textcore import column, tidied

CACHE = 300_000
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


class _Counts(dict):
    def __init__(self, count):
        self.count = count

    def __missing__(self, part: str) -> tuple[int, float]:
        if len(self) >= CACHE:
            self.clear()
        out = self.count(part)
        if len(part) <= 64:
            self[part] = out
        return out


class UnigramCounter:
    """Scores and counts under ``pieces``: piece to score.  ``fallback``: unknown characters count as bytes."""

    def __init__(self, pieces: dict[str, float], fallback: bool = True):
        self.pieces, self.fallback = pieces, fallback
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.matches.add_word(piece, (len(piece), float(score)))
        self.matches.make_automaton()
        self.cut = None
        if SPACE in pieces and not any(SPACE in p.lstrip(SPACE) for p in pieces):
            # a line feed in no piece is always unknown by itself
            ends = SPACE if any("\n" in p for p in pieces) else SPACE + r"\n"
            self.cut = regex.compile(rf"{SPACE}+[^{ends}]*|[^{ends}]+|\n+")
        self.counts = _Counts(self.count_part)

    def count_part(self, text: str) -> tuple[int, float]:
        """Piece count and score of the best segmentation of ``text``."""
        n = len(text)
        score, count, unknown_from = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        done = 0

        def unknown(end: int, best: float, held: int, since: int) -> None:
            # the candidate that starts last, hence tried last: it wins only if better
            if (s := score[end - 1] + self.unknown) > best:
                run = unknown_from[end - 1]
                score[end], count[end], unknown_from[end] = s, count[end - 1], end - 1 if run < 0 else run
                if run < 0:
                    count[end] += self.weight(text[end - 1 : end])
                else:
                    count[end] += self.weight(text[run:end]) - self.weight(text[run : end - 1])
            else:
                score[end], count[end], unknown_from[end] = best, held, since

        best, held, single, end = float("-inf"), 0, False, 0
        for last, (length, s) in self.matches.iter(text):
            if last + 1 != end:
                if end:
                    if single:
                        score[end], count[end] = best, held
                    else:
                        unknown(end, best, held, -1)
                    done = end
                for gap in range(done + 1, last + 1):
                    unknown(gap, float("-inf"), 0, -1)
                done, end, best, held, single = last, last + 1, float("-inf"), 0, False
            start = end - length
            if (s := score[start] + s) > best:
                best, held = s, count[start] + 1
            single = single or length == 1
        if end:
            if single:
                score[end], count[end] = best, held
            else:
                unknown(end, best, held, -1)
            done = end
        for gap in range(done + 1, n + 1):
            unknown(gap, float("-inf"), 0, -1)
        return count[n], score[n]

    def weight(self, unknown: str) -> int:
        """Tokens of a run of unknown characters, which are fused into one."""
        if unknown in self.pieces or not self.fallback:
            return 1
        return len(unknown.encode())

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and best score of a whole text; none for an empty one."""
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if self.cut is None:
            return self.count_part(text)
        n, total = 0, 0.0
        for k, s in map(self.counts.__getitem__, self.cut.findall(text)):
            n += k
            total += s
        return n, total


@lru_cache(maxsize=4)
def load(path: str) -> UnigramCounter:
    """The normal and user-defined pieces of a sentencepiece model, with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    other = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
    return UnigramCounter({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not other(i)})


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count each whole text's tokens, without a shuffle.

    Returns ``id_col``, n_tokens (long) and score (double, of the best
    segmentation).  Null and empty texts have 0 tokens and score 0.  Repeated
    rows each give a row, null ids stay null, other columns are not read, an
    empty table gives none.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, score double"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            found = [counter.count(t.as_py() or "") for t in column(batch, text_col)]
            yield pa.RecordBatch.from_pydict({id_col: column(batch, id_col), "n_tokens": pa.array([n for n, _ in found], pa.int64()), "score": pa.array([s for _, s in found], pa.float64())})
        counter.counts.clear()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
