import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from fixtures import awkward, frame
from nightglass.llm import bpe, packing, unigram_count

PATH, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(PATH)


def odd_texts(n=200):
    r = random.Random(1)
    bits = ["a", "the", "  ", "\n", "\t", "1", "é", "😀", "'s", "'LL", "<|endoftext|>", " ", " ", "\x1c", "\x85", "!!", "中文", "ß", "\r\n", "²", "𝟘"]
    return ["".join(r.choices(bits, k=r.randint(0, 120))) for _ in range(n)] + ["ab" * 3000 + "é" * 900, "", " ", "x" * 5000]


def test_encode_as_the_library():
    own = bpe.ByteBPE(PATH)
    texts = odd_texts() + [t or "" for _, t in awkward()]
    for t, packed in zip(texts, own.encode_many(texts)):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert own.encode(t).tolist() == want
        assert own.decode(want) == LIBRARY.decode(want, skip_special_tokens=False) == t


def test_every_code_point_class():
    own = bpe.load(PATH)
    for c in [*range(0x0, 0x3100), *range(0xA000, 0xAC00, 7), *range(0x10000, 0x20000, 97)]:
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}b 1{chr(c)} {chr(c)}\n"
            assert own.encode(t).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, hex(c)


def test_decode_broken_bytes():
    own = bpe.load(PATH)
    ids = [own.byte_id[b] for b in b"a\xff\xe2\x82b\xc3"]
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("open_", [1, 2, 3, 4])
def test_few_words_still_open(open_):
    """Words of one width of which all but a few have no merge left."""
    own = bpe.ByteBPE(PATH)
    words = ["\x00\x01\x02"] * 9 + ["hel", "wor", "tok", "abc"][:open_]
    for texts in (["hello"], [" hello"], [" ".join(words)], words):
        for t, packed in zip(texts, own.encode_many(texts)):
            assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 5, 6, 7, 10, 11, 16, 17, 28, 29, 255, 256, 257, 400, 401])
def test_word_widths(size):
    own, r = bpe.ByteBPE(PATH), random.Random(size)
    texts = ["".join(r.choices(kind, k=size)) for kind in ("etaoinsh", "abcdefghijklmnopqrstuvwxyz", "x") for _ in range(5)] + ["é" * (size // 2)]
    for t, packed in zip(texts, own.encode_many(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_words_of_one_hash(monkeypatch):
    """Pre-tokens are told apart by their bytes where hashes fail."""
    monkeypatch.setattr(bpe.tc, "span_hashes", lambda data, starts, ends, which=0: (ends - starts).astype(np.uint64))
    own, texts = bpe.ByteBPE(PATH), ["some words here", "other words there", "more text now", ""]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts():
    """Texts over a block, and over a batch, of ``textcore``."""
    r = random.Random(2)
    texts = ["".join(r.choices("abc de\n", k=1_500_000)), "a" * 70_000, "naïve " * 250_000]
    for t, packed in zip(texts, bpe.load(PATH).encode_many(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    own = bpe.ByteBPE(PATH)
    texts = [" ".join(f"word{i}x{j}" for j in range(20)) for i in range(20)]
    for t, packed in zip(texts, own.encode_many(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_query_rows(spark):
    rows = awkward()
    got = bpe.encode_documents(frame(spark, rows), PATH, with_ids=True).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(r["decoded"] is not None and len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe.encode_documents(frame(spark, []), PATH).count() == 0


def test_unigram_counts_as_the_library(spark):
    counter = unigram_count.load(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = [(p, counter.pieces.get(p, 0.0)) for p in map(sp.id_to_piece, range(sp.get_piece_size()))]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    space = unigram_count.SPACE
    rows = awkward() + [(1000 + i, t) for i, t in enumerate(odd_texts()[:-1])]
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in unigram_count.count_tokens(frame(spark, rows), PIECES).collect())
    assert got == collections.Counter((i, len(library.encode(space + t.replace(" ", space), add_special_tokens=False).ids) if t else 0) for i, t in rows)
    assert unigram_count.count_tokens(frame(spark, []), PIECES).count() == 0


def test_unigram_ties_and_scores():
    # aab: a+ab and aa+b tie, and so does the whole: the piece that starts first stays
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.0, "aa": -3.0, "ab": -3.0, "aab": -5.0}
    counter = unigram_count.UnigramCounter(pieces, fallback=False)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], unk_id=0))
    r = random.Random(3)
    for t in ["aab", "abaab", "zzab", "a z"] + ["".join(r.choices("aabz ", k=r.randint(1, 30))) for _ in range(300)]:
        assert counter.count(t)[0] == len(library.encode("▁" + t.replace(" ", "▁")).ids), t


def brute_score(pieces, text, unknown):
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            p = text[start:end]
            s = pieces.get(p, unknown if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_unigram_score():
    pieces = {"▁": -1.5, "a": -2.0, "ab": -2.5, "bc": -3.0, "abc": -9.0}
    counter = unigram_count.UnigramCounter(pieces)
    for t in ("abc", "aabc bcab", "z abc"):
        assert counter.count(t)[1] == pytest.approx(brute_score(pieces, "▁" + t.replace(" ", "▁"), counter.unknown))


# packing


def check_plan(counts, capacity):
    groups = packing.plan(counts, capacity)
    packed = collections.Counter()
    for content, n in groups:
        tokens = sum(k * c for k, c in content)
        assert tokens <= capacity.limits[0] and sum(c for _, c in content) <= capacity.limits[1] and sum(k * k * c for k, c in content) <= capacity.limits[2]
        for k, c in content:
            packed[k] += c * n
    assert packed == collections.Counter({k: n for k, n in counts.items() if n})
    return sum(n for _, n in groups)


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(100, 4, 3000), packing.Capacity(100, 3, 0, rule="dot"), packing.Capacity(100, 0, 2500, (1, 1, 1))])
def test_plan(capacity):
    r = random.Random(2)
    for _ in range(20):
        counts = {k: r.randint(1, 50) for k in r.sample(range(1, capacity.longest() + 1), min(30, capacity.longest()))}
        n = check_plan(counts, capacity)
        assert n >= sum(k * c for k, c in counts.items()) / capacity.tokens
    assert packing.plan({}) == []


def test_plan_is_tight():
    r = random.Random(4)
    counts = collections.Counter(r.randint(1, 2048) for _ in range(4000))
    assert check_plan(counts, packing.Capacity()) <= 1.02 * sum(k * c for k, c in counts.items()) / 2048
    assert check_plan({1: 10**9, 2048: 5}, packing.Capacity()) == 5 + -(-(10**9) // 2048)


def test_pack_rows(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = packing.pack(frame(spark, rows), PATH).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        at, k = 0, 0
        while at < len(ids):
            n = len(ids) % 2048 or 2048 if not k else 2048
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.1 * sum(r["length"] for r in got) / 2048 + 1
    assert packing.pack(frame(spark, []), PATH).count() == 0
    assert packing.pack(frame(spark, [(None, None), (None, "x")]), PATH).count() == 2


def test_hot_length_is_salted(spark):
    rows = [(i, "same") for i in range(6000)] + [(10000 + i, "w " * i) for i in range(50)]
    got = packing.pack(frame(spark, rows), PATH).toPandas()
    assert len(got) == 6050 and not got.duplicated(["sequence_id", "offset"]).any()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
