"""Texts that are longer than the blocks that operators work on."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fixtures import frame, repeated, words
from nightglass.llm import bagminhash, cnn_quality, crf_secrets, ctph, recompression, repetition, unigram_count
from nightglass.llm import textcore as tc

PASSAGE = " ".join(f"p{i}" for i in range(60))


def long_text(seed=1, size=1_400_000):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(30_000)] + ["naïve", "日本", "x\n"]
    out, n = [], 0
    while n < size:
        out.append(r.choice(vocab))
        n += len(out[-1]) + 1
    return " ".join(out)


LONG = long_text()


@pytest.fixture(scope="module")
def rows():
    assert len(LONG.encode()) > tc.BLOCK_BYTES
    return [(1, f"short {PASSAGE} text"), (2, f"{LONG} {PASSAGE} {LONG[:9000]}"), (3, f"before {PASSAGE} after"), (4, f"{LONG} {PASSAGE} {LONG[:8000]}")]


def test_repetition(spark, rows):
    got = {r["doc_id"]: r for r in repetition.repetition_rules(frame(spark, rows)).collect()}
    for i, t in rows:
        w, held = repeated(t, 3)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(held))


def test_near_duplicates(spark, rows):
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(frame(spark, rows)).collect()}
    assert got[2] == got[4] == 2 and got[1] == 1


def test_remove_repeats(spark, rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(hash(tuple(w[k : k + 13])), i)
    got = {r["doc_id"]: r for r in recompression.remove_repeats(frame(spark, rows)).collect()}
    for i, t in rows:
        w = words(t)
        mask = np.ones(len(w), bool)
        for k in range(len(w) - 12):
            if first[hash(tuple(w[k : k + 13]))] < i:
                mask[k : k + 13] = False
        kept = [x for x, m in zip(w, mask) if m]
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_fingerprints_and_scores(spark, rows):
    texts = [t for _, t in rows]
    assert ctph.fingerprints(texts) == [ctph.fingerprints([t])[0] for t in texts]
    got = {r["doc_id"]: r for r in ctph.compare_with_next(frame(spark, rows)).collect()}
    assert all(got[i]["n_chars"] == len(t) for i, t in rows) and ctph.likeness(got[2]["fingerprint"], got[4]["fingerprint"]) > 0.9
    net = cnn_quality.ByteCnn.new()
    net.out = np.linspace(-1, 1, 2 * cnn_quality.FILTERS).astype(np.float32)
    scores = {r["doc_id"]: r["score"] for r in cnn_quality.score_quality(frame(spark, rows), net).collect()}
    for i, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert scores[i] == pytest.approx(net.score_block(raw, np.array([0, len(raw)]))[0], abs=1e-5)


def test_secrets_at_the_end(spark):
    text = f"{LONG}\nmy password is correcthorsebatterystaple, as it was\ntoken = abcdefghijkl0123"
    row = crf_secrets.find_secrets(frame(spark, [(1, text)]), redacted=True).first()
    assert row["n_assign"] == 1 and row["redacted"].endswith("my password is [SECRET], as it was\n[SECRET]") and row["redacted"].startswith(LONG[:200_000])


def test_token_counts():
    counter = unigram_count.load(public_tokenizers.path("piece_bpe_32k.model"))
    parts = LONG.split(" ")
    # no piece runs from another character into a space, so the parts' counts add up
    assert counter.count(LONG)[0] == sum(counter.count(p)[0] for p in parts if p) + parts.count("")


def test_blocks_cover_the_column():
    texts = ["a b", "", LONG, None, "c"]
    seen = [(b.first, b.n) for b in tc.blocks(pa.array(texts))]
    assert sum(n for _, n in seen) == 5 and [f for f, _ in seen] == sorted({f for f, _ in seen})
