"""Nulls, empty tables and clashing names, operator by operator."""

import public_tokenizers

from fixtures import frame
from nightglass.llm import bagminhash, bpe, cnn_quality, crf_secrets, ctph, packing, recompression, repetition, unigram_count

PATH, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EVERY = (
    lambda df: bpe.encode_documents(df, PATH),
    lambda df: cnn_quality.score_quality(df, cnn_quality.fit([], [])),
    lambda df: packing.pack(df, PATH),
    lambda df: ctph.compare_with_next(df, buckets=4),
    bagminhash.near_duplicates,
    bagminhash.keep_one,
    recompression.remove_repeats,
    crf_secrets.find_secrets,
    repetition.repetition_rules,
    lambda df: unigram_count.count_tokens(df, PIECES),
)


def test_null_ids_and_texts_only(spark):
    for f in EVERY:
        assert f(frame(spark, [(None, "a"), (None, "b"), (None, None)])).count() == 3


def test_empty_tables(spark):
    for f in EVERY:
        assert f(frame(spark, [])).count() == 0


def test_one_id_with_null_texts(spark):
    for f in EVERY:
        assert f(frame(spark, [(1, None)] * 5 + [(2, "x")])).count() == (2 if f is bagminhash.keep_one else 6)


def test_columns_with_names_of_results(spark):
    wide = frame(spark, [(1, "x y")]).withColumnsRenamed({"lang": "score", "source": "spans", "bucket": "word"})
    assert cnn_quality.score_quality(wide, cnn_quality.fit([], []), passing=("score", "n_tokens")).columns == ["doc_id", "n_tokens", "score", "predicted"]
    got = crf_secrets.find_secrets(wide, passing=("spans", "n_tokens"))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "n_tokens"] and got.first()["spans"] == ""
    assert bagminhash.keep_one(wide).columns == wide.columns
    for f in EVERY:
        assert f(wide).count() == 1
