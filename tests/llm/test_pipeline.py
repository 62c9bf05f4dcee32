import collections
import os
import re
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fixtures import awkward, classes, frame, kept_words, words
from nightglass.llm import cnn_quality, crf_secrets
from plain_quality import brute_score

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_pipeline(rows, net, crf):
    """{doc_id: text} after quality, near duplicates, repeats and secrets, each by a plain version."""
    rows = [(i, t) for i, t in rows if brute_score(net, t.encode()) >= 0.3]
    kept = classes(rows)
    rows = sorted((i, t) for i, t in rows if kept[i] == i)
    texts = dict(rows)
    out = {}
    for i, w, mask in kept_words(rows):
        if all(mask):
            out[i] = texts[i]
        elif any(mask):
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i])]
            parts, k = [], 0
            while k < len(w):
                if mask[k]:
                    j = k
                    while j + 1 < len(w) and mask[j + 1]:
                        j += 1
                    parts.append(texts[i][spans[k][0] : spans[j][1]])
                    k = j
                k += 1
            out[i] = "\n".join(parts)
    for i, t in out.items():
        marks = [0] * (len(t) + 1)  # of each character, whether it is inside a span, and whether it goes on from the one before
        for a, b, _ in crf_secrets.scan([t], crf)[0][1]:
            for k in range(a, b):
                marks[k] = 2 if marks[k] == 2 or k > a else 1
        out[i] = "".join(c if not m else "[SECRET]" if m == 1 else "" for c, m in zip(t, marks))
    return out


def test_against_plain_versions(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    net = cnn_quality.train(docs, labels)
    want = plain_pipeline([(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()], net, crf_secrets.train())
    df = docs
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, SMALL)
    assert {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} == want
    pieces = collections.defaultdict(list)
    for r in P.run(spark, SMALL).collect():
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == want.keys()
    sequences = collections.defaultdict(list)
    for i, t in want.items():
        ids, at = [*LIBRARY.encode(t, add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            some = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(some.tobytes())) and (len(ids) > 2048 or r["length"] == len(ids))
            at += r["length"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert at == len(ids)
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    least = -(-sum(len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for t in want.values()) // 2048)
    assert len(sequences) <= least + 2


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    df = docs
    for name, stage in P.STAGES:
        df = stage(spark, df, SF).cache()
        seen.append(df.count())
        if name != P.STAGES[-1][0]:
            assert df.columns == docs.columns and dict(df.dtypes) == dict(docs.dtypes)
            assert df.filter("n_chars != length(text)").count() == 0
    assert 1000 > seen[0] > seen[1] >= seen[2] == seen[3] > 700
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/nightglass"
    before = set(os.listdir(folder))
    again = P.run(spark, SF)
    assert again.count() == seen[4] and again.agg({"length": "sum"}).first()[0] == df.agg({"length": "sum"}).first()[0]
    assert [t.rsplit("-", 1)[0] for t in set(os.listdir(folder)) - before] == ["pieces"]


def test_awkward_rows(spark):
    df = frame(spark, awkward()).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        df = stage(spark, df, SF).cache()
        df.count()
    empty = frame(spark, []).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_words_of_the_result(spark):
    """Repeats of the near-deduplicated texts are gone, whatever stands around them."""
    rows = [(1, "alpha " + " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(20, 40)) + " " + " ".join(f"z{i}" for i in range(90)))]
    got = {r["doc_id"]: r["text"] for r in P.substring_dedup(spark, frame(spark, rows).select(*P.COLUMNS), SF).collect()}
    assert words(got[2]) == [f"z{i}" for i in range(90)] and got[1] == rows[0][1]
