"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nightglass.llm import bagminhash, bpe, cnn_quality, crf_secrets, ctph, html_mincut, packing, recompression, repetition, unigram_count

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = cnn_quality.train(docs, _table(spark, sf_dir, "labels"))
    out = cnn_quality.score_quality(docs, net)
    return out.select("doc_id", cnn_quality.held_out(out["doc_id"]).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_next(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract_pages(_table(spark, sf_dir, "pages"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(_table(spark, sf_dir, "documents"), UNIGRAM)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_packing, op4_fingerprint, op5_html, op6_near_dedup, op7_substring_dedup, op8_secrets, op9_repetition, op10_token_counts)}


_WORDS = r"w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"


def _grams(name: str, k: int) -> str:
    """SQL of the runs of ``k`` words: (doc_id, i, g), i from 1."""
    return f"{name} AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {k - 1}), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w) AS x)"


def _near_sql() -> str:
    return f"""WITH RECURSIVE {_WORDS}, {_grams("runs", bagminhash.SHINGLE)},
  every AS (SELECT doc_id, g FROM runs UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {bagminhash.SHINGLE - 1}),
  bag AS (SELECT doc_id, g, count(*) AS c FROM every GROUP BY doc_id, g), size AS (SELECT doc_id, sum(c) AS n FROM bag GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o FROM bag AS a JOIN bag AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  near AS (SELECT a, b FROM shared JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 5 * o >= 4 * (x.n + y.n - o)
    UNION ALL SELECT x.doc_id, y.doc_id FROM w AS x JOIN w AS y ON x.doc_id < y.doc_id WHERE len(x.ws) = 0 AND len(y.ws) = 0),
  edge AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
  reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach AS r JOIN edge AS e ON e.a = r.id)
  SELECT id AS doc_id, min(c) AS class_id FROM reach GROUP BY id"""


def _repeats_sql() -> str:
    k = recompression.WINDOW
    return f"""WITH {_WORDS}, {_grams("win", k)}, first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
  taken AS (SELECT DISTINCT win.doc_id, i + j AS p FROM win JOIN first ON first.g = win.g AND m < win.doc_id, range({k}) AS r(j)),
  words AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) AS x),
  kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN taken USING (doc_id, p) GROUP BY words.doc_id)
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def _repetition_sql() -> str:
    rules = repetition.RepetitionRules()
    parts = [_WORDS, "words AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) AS x)"]
    for k in (3, *(n for n, _ in rules.ngrams)):
        parts.append(_grams(f"g{k}", k))
        parts.append(f"d{k} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{k}) AS x WHERE c > 1)")
        parts.append(f"c{k} AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM (SELECT DISTINCT doc_id, i + j AS p FROM d{k}, range({k}) AS r(j)) AS x JOIN words USING (doc_id, p) GROUP BY doc_id)")
    parts.append(r"lines AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) AS x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)")
    parts.append(r"dup AS (SELECT doc_id, sum(c - 1) AS n, sum((c - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines GROUP BY doc_id)")
    counts = r"SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM w"
    joins = " ".join(f"LEFT JOIN c{k} ON c{k}.doc_id = b.doc_id" for k in (3, *(n for n, _ in rules.ngrams)))
    made = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n, _ in rules.ngrams)
    verdict = " AND ".join(["NOT base_failed", *(f"100 * dup_{n}gram_chars <= {limit} * word_chars" for n, limit in rules.ngrams), f"100 * dup_line_chars <= {rules.max_dup_line_chars} * word_chars"])
    failed = f"n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words} * n_words"
    return f"""WITH {", ".join(parts)}, base AS (SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words, {made}, coalesce(dup.chars, 0)::BIGINT AS dup_line_chars
    FROM ({counts}) AS b {joins} LEFT JOIN dup ON dup.doc_id = b.doc_id), judged AS (SELECT *, {failed} AS base_failed FROM base) SELECT *, {verdict} AS kept FROM judged"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that DuckDB can express."""
    return {"op6_near_dedup": _near_sql(), "op7_substring_dedup": _repeats_sql(), "op9_repetition": _repetition_sql()}
