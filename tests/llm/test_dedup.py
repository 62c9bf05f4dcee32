import collections
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fixtures import awkward, classes, frame, kept_words, words
from nightglass.llm import bagminhash as B
from nightglass.llm import packed
from nightglass.llm import recompression as R
from nightglass.llm import textcore as tc
from nightglass.llm.shared import materialise, scratch


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = awkward(seed)
    got = B.near_duplicates(frame(spark, rows)).collect()
    want = classes(rows)
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == collections.Counter((i, want.get(i)) for i, _ in rows)


def test_near_duplicates_of_nothing(spark):
    assert B.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in B.near_duplicates(frame(spark, [(None, "a"), (None, None)])).collect()] == [(None, None)] * 2


def test_group_of_copies_and_chain(spark):
    """A long chain of near copies, whose ends aren't alike, and a star of many."""
    r = random.Random(5)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    rows, w = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(w)))
        k = r.randrange(len(w))
        w = w[:k] + [f"n{i}"] + w[k + 1 :]
    other = [f"z{r.randrange(500)}" for _ in range(150)]
    for i in range(100, 220):
        k = r.randrange(len(other))
        rows.append((i, " ".join(other[:k] + [f"m{i}"] + other[k + 1 :])))
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_keep_one(spark):
    rows = awkward()
    want = classes(rows)
    kept = B.keep_one(frame(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c}) and ids.count(None) == 2
    assert kept.columns == frame(spark, rows).columns


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        n = r.integers(5, 60)
        a = r.integers(0, 9, n)
        b = np.where(r.random(n) < 0.6, a, r.integers(0, 9, n))
        g = r.integers(0, 1 << 62, n).astype(np.uint64)
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = B.signatures(doc, np.concatenate((g[a > 0], g[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2, 1000)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.008 and np.std(errors) < 0.025


def thue_morse(n):
    """A word over a and b, and its complement: equal under polynomial hashes modulo powers of 2."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_hot_buckets(spark, monkeypatch):
    """Pairs of hot buckets are looked for by two buckets; heads' texts are dealt in many parts."""
    monkeypatch.setattr(B, "HOT_BUCKET", 2)
    monkeypatch.setattr(B, "WITH_HEAD", 3)
    r = random.Random(6)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for g in range(12):  # pages of one template; each group is near itself alone
        own = [f"g{g}w{i}" for i in range(40)]
        for k in range(4):
            w = template + own
            w[60 + r.randrange(40)] = f"new{g}.{k}"
            rows.append((100 * g + k, " ".join(w)))
    got = {x["doc_id"]: x["class_id"] for x in B.near_duplicates(frame(spark, rows), how=B.NearDedup(star_rounds=1)).collect()}
    assert got == classes(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_hot_buckets_without_another_one(spark, monkeypatch, rounds):
    """Near documents that share one hot bucket and no other are joined, whatever chunks they are in."""
    monkeypatch.setattr(B, "HOT_BUCKET", 2)
    monkeypatch.setattr(B, "CHUNK", 3, raising=False)
    r = random.Random(8)
    rows = []
    for g in range(12):
        own = [f"t{i}" for i in range(60)] + [f"g{g}w{i}" for i in range(40 + 7 * (g % 5))]
        for k in range(1 if g % 4 == 3 else 7):
            w = list(own)
            w[60 + r.randrange(40)] = f"new{g}.{k}"
            rows.append((100 * g + k, " ".join(w)))
    r.shuffle(rows)
    how = B.NearDedup(bands=1, rows=1, star_rounds=rounds)
    bucket = {x["id"]: x["buckets"][0] for x in how.sketch(frame(spark, rows).select(F.col("doc_id").alias("id"), "text")).collect()}
    assert max(collections.Counter(bucket.values()).values()) > 6
    near = B.components(spark.createDataFrame([(a, b) for a, b in ((a, b) for a, _ in rows for b, _ in rows if a < b and bucket[a] == bucket[b]) if len(set(classes([x for x in rows if x[0] in (a, b)]).values())) == 1], "a long, b long"))
    want = {i: i for i, _ in rows} | {x["id"]: x["class"] for x in near.collect()}
    got = {x["doc_id"]: x["class_id"] for x in B.near_duplicates(frame(spark, rows), how=how).collect()}
    assert got == want


def test_repeated_ids(spark):
    """Of an id with several texts that with the least digest counts, in whatever order the rows come."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    first = min((a, b), key=lambda t: hashlib.md5(t.encode()).digest())
    other = b if first == a else a
    for rows in ([(5, a), (5, b), (7, first), (9, other), (9, c)], [(9, c), (9, other), (7, first), (5, b), (5, a)]):
        got = collections.Counter((x["doc_id"], x["class_id"]) for x in B.near_duplicates(frame(spark, rows)).collect())
        nine = min((other, c), key=lambda t: hashlib.md5(t.encode()).digest())
        assert got == {(5, 5): 2, (7, 5): 1, (9, 9): 2}
        assert sorted((x["doc_id"], x["text"]) for x in B.keep_one(frame(spark, rows)).collect()) == [(5, first), (9, nine)]


@pytest.mark.parametrize("bits", [1 << 26, 128])
def test_by_bitmap(spark, monkeypatch, bits):
    """The parts are the rows; ids that are asked for are all in the first, also where most bits are set."""
    monkeypatch.setattr(B, "BITMAP", bits)
    rows = spark.range(2000).selectExpr("id - 1000 AS key", "id AS word", "'x' AS mask")
    ids = spark.range(0, 900, 3).selectExpr("id")
    asked, others = B.by_bitmap(rows, "key", ids)
    a, b = ({r["key"] for r in x.collect()} for x in (asked, others))
    assert asked.columns == others.columns == rows.columns and not a & b and a | b == set(range(-1000, 1000)) and set(range(0, 900, 3)) <= a
    assert len(a) < 320 or bits == 128


def tables_left(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/nightglass"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_the_tables_that_a_result_reads_are_left(spark):
    rows = awkward()
    before = tables_left(spark)
    B.near_duplicates(frame(spark, rows)).count()
    near = tables_left(spark) - before
    assert sorted(t.rsplit("-", 1)[0] for t in near) == ["firsts", "labels", "sketches"]
    R.remove_repeats(frame(spark, rows)).count()
    assert sorted(t.rsplit("-", 1)[0] for t in tables_left(spark) - before - near) == ["judged", "windows-shared"]
    before = tables_left(spark)
    with pytest.raises(ZeroDivisionError), scratch():
        materialise(frame(spark, rows), "x")
        1 / 0
    assert tables_left(spark) == before


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(200, 300 + i) for i in range(50)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    r.shuffle(edges)
    got = {x["id"]: x["class"] for x in B.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# substring dedup


def expected(rows):
    return collections.Counter((i, len(w), m.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, m) if k).encode()).hexdigest()) for i, w, m in kept_words(rows))


@pytest.mark.parametrize("seed,hot", [(1, 0.02), (2, 1e-9)])
def test_remove_repeats(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(packed, "LEAST_HOT", 0)
    rows = awkward(seed)
    got = R.remove_repeats(frame(spark, rows), how=R.SubstringDedup(hot=hot), passing=("lang", "n_tokens"), with_text=True).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == expected(rows)
    assert all(r["lang"] == "en" and r["n_tokens"] == 7 for r in got)
    assert all(len(words(r["kept_text"])) == r["n_words"] - r["n_removed"] for r in got)


@pytest.mark.parametrize("size", [1024, 8192])
def test_words_that_polynomial_hashes_confuse(spark, size):
    x, y = thue_morse(size)
    r = random.Random(size)
    base = [r.choice((x, y)) for _ in range(30)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:20] + ["z"])), (3, " ".join(x if w == y else y for w in base)), (4, " ".join([x] * 13)), (5, " ".join([y] * 13))]
    got = R.remove_repeats(frame(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == expected(rows)


def test_few_partitions_of_many_parts(spark, monkeypatch):
    """Places are parts of a bounded number of partitions."""
    monkeypatch.setattr(packed, "PLACE_BYTES", 500)
    rows = awkward(3)
    got = R.remove_repeats(frame(spark, rows), how=R.SubstringDedup(partitions=3)).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == expected(rows)
    places, ids = packed.Places(3, 7), np.array([0, 1, -5, 1 << 40, -(1 << 50) + 3, 999_999_937])
    df = spark.createDataFrame([(int(i),) for i in ids], "id long").select("id", *[c.alias(k) for k, c in places.columns(F.col("id")).items()])
    place, sub = places.of_ids(ids)
    assert {r["id"]: (r["place"], r["sub"]) for r in df.collect()} == {int(i): (int(p), int(q)) for i, p, q in zip(ids, place, sub)}


def test_names_of_two_words():
    names = np.array([[7, 1], [7, 2], [5, 9], [7, 1], [5, 9]], np.uint64)
    got, least, most, n = packed._combined(names, np.array([4, 5, 6, 2, 6]))
    assert {tuple(k): (a, b, c) for k, a, b, c in zip(got.tolist(), least, most, n)} == {(7, 1): (2, 4, 2), (7, 2): (5, 5, 1), (5, 9): (6, 6, 2)}
    table = got[np.argsort(got[:, 0], kind="stable")]
    at, there = packed.found_names(table, np.array([[7, 2], [7, 1], [7, 3], [5, 9], [5, 1], [9, 9]], np.uint64))
    assert there.tolist() == [True, True, False, True, False, False] and table[at[there]].tolist() == [[7, 2], [7, 1], [5, 9]]


def test_rows_of_one_id_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    got = R.remove_repeats(frame(spark, [(1, a), (2, a), (2, b)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0), (2, 20)]


def test_passing_columns_with_names_of_results(spark):
    rows = frame(spark, [(1, "a b")]).withColumnsRenamed({"lang": "n_words", "source": "kept_text"})
    got = R.remove_repeats(rows, passing=("n_words", "kept_text", "n_tokens"), with_text=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "n_tokens", "kept_text"] and got.first()["n_words"] == 2


def test_remove_repeats_few_words(spark):
    """Runs and periods: texts over one, two and three words."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["a", "b", "c"][: r.randint(1, 3)], k=r.randint(0, 60)))) for i in range(60)]
    got = R.remove_repeats(frame(spark, rows)).collect()
    assert collections.Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == expected(rows)


def test_remove_repeats_of_nothing(spark):
    assert R.remove_repeats(frame(spark, [])).count() == 0
    got = R.remove_repeats(frame(spark, [(None, "a " * 20), (None, "a " * 20), (None, None)])).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (20, 0), (20, 0)]


def test_equal_windows_have_one_representative():
    r = random.Random(3)
    for _ in range(60):
        v = r.choice([1, 2, 3, 6, 50])
        passage = " ".join(str(r.randrange(v)) for _ in range(r.randint(13, 40)))
        docs = [" ".join(str(r.randrange(v)) for _ in range(r.randint(0, 30))) + " " + r.choice(["", passage]) + " " + " ".join(str(r.randrange(v)) for _ in range(r.randint(0, 30))) for _ in range(6)]
        seen = {}
        flat = " ".join(docs).split()
        for b in tc.blocks(pa.array(docs)):
            names = R.representatives(b.word_hashes(), b.word_offsets)
            for i in np.flatnonzero(tc.whole_ngrams(b.word_offsets, 13)):
                assert seen.setdefault(tuple(flat[i : i + 13]), names[i]) == names[i]


def test_keep_one_of_hot_buckets(spark, monkeypatch):
    """``keep_one``, which the pipeline uses, drops near documents that share one hot bucket and no other."""
    monkeypatch.setattr(B, "HOT_BUCKET", 2)
    monkeypatch.setattr(B, "CHUNK", 3, raising=False)
    shared = [f"t{i}" for i in range(60)]
    rows = []
    for g in range(8):  # each group is near itself alone
        for k in range(5):
            w = shared + [f"g{g}w{i}" for i in range(40)]
            w[60 + 8 * k] = f"new{g}.{k}"
            rows.append((10 * g + k, " ".join(w)))
    # one bucket for all, as with a very common least point
    monkeypatch.setattr(B, "band_names", lambda signature, bands, rows: np.zeros((len(signature), 1), np.uint64))
    kept = B.keep_one(frame(spark, rows), how=B.NearDedup(bands=1, rows=1, star_rounds=0)).collect()
    assert sorted(r["doc_id"] for r in kept) == [10 * g for g in range(8)]


def test_pairs_of_a_hot_bucket(spark, monkeypatch):
    """Where each text of a hot bucket is near one other, as many pairs are verified as there are, not all that the bounds allow."""
    monkeypatch.setattr(B, "HOT_BUCKET", 20)
    rows = []
    for g in range(50):
        own = [f"g{g}w{i}" for i in range(100)]
        rows += [(2 * g, " ".join([f"t{i}" for i in range(300)] + own)), (2 * g + 1, " ".join([f"t{i}" for i in range(300)] + own[:30] + ["new"] + own[31:]))]
    monkeypatch.setattr(B, "band_names", lambda signature, bands, rows: np.zeros((len(signature), 1), np.uint64))
    asked, verify = [], B.NearDedup.verify

    def counted(self, pairs, texts):
        asked.append(pairs.count())
        return verify(self, pairs, texts)

    monkeypatch.setattr(B.NearDedup, "verify", counted)
    got = {x["doc_id"]: x["class_id"] for x in B.near_duplicates(frame(spark, rows), how=B.NearDedup(bands=1, rows=1, star_rounds=0)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
    assert asked[0] == 99 and asked[1] <= 60


@pytest.mark.parametrize("run", ["near_duplicates", "keep_one"])
def test_rows_of_joins_by_id(spark, monkeypatch, run):
    """Joins by id make rows for pairs and texts, not for each key of a text, of which there are many."""
    monkeypatch.setattr(B, "HOT_BUCKET", 20)
    rows = []
    for g in range(50):
        own = [f"g{g}w{i}" for i in range(100)]
        rows += [(2 * g, " ".join([f"t{i}" for i in range(300)] + own)), (2 * g + 1, " ".join([f"t{i}" for i in range(300)] + own[:30] + ["new"] + own[31:]))]
    monkeypatch.setattr(B, "band_names", lambda signature, bands, rows: np.zeros((len(signature), 1), np.uint64))
    docs = frame(spark, rows)
    made, join = [], type(docs).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and on == "id" and how is None:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "join", counted)
    got = getattr(B, run)(docs, how=B.NearDedup(bands=1, rows=1, star_rounds=0))
    kept = got.filter("doc_id = class_id") if run == "near_duplicates" else got
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * g for g in range(50)]
    assert max(made) <= 200  # 99 members and a head; before, the rare shingles of all texts


@pytest.mark.parametrize("slots", [1 << 18, 7])
def test_rare_shingles(spark, monkeypatch, slots):
    """Any two similar texts have a rare shingle in common, also those with repeated ones and where slots are shared."""
    monkeypatch.setattr(B, "SLOTS", slots, raising=False)
    r = random.Random(4)
    texts = []
    for g in range(12):
        w = [f"v{r.randrange(3 if g % 3 == 0 else 40)}" for _ in range(r.randint(5, 90))] * (1 + g % 2)
        for _ in range(5):
            texts.append([f"n{r.randrange(9)}" if r.random() < 0.03 else x for x in w])
    bag = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts]
    keys = collections.defaultdict(set)
    for x in B.rare_shingles(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string").repartition(3), 0.8).collect():
        keys[x["id"]].add(x["key"])
    near = [(a, b) for a in range(60) for b in range(a) if (bag[a] & bag[b]).total() >= 0.8 * (bag[a] | bag[b]).total()]
    assert len(near) > 20 and all(keys[a] & keys[b] for a, b in near)
    assert slots == 7 or sum(map(len, keys.values())) < 0.5 * sum(map(len, bag))
