"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldspark.llm import (
    byte_bpe, collocations, embedding_dedup, fill_in_middle, fingerprints, language_id, packing, pii, quality, secrets, simhash_dedup,
    token_counts, toxicity,
)

#: Files of the tokenizers; the driver reads them and sends their content with the tasks.
BYTE_BPE_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE_FILE = public_tokenizers.path("word_bpe_49k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_docs(spark, sf_dir)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(secrets.find(_docs(spark, sf_dir)), secrets.KINDS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(WORD_BPE_FILE, encoding="utf-8") as file:
        return packing.pack_documents(_docs(spark, sf_dir), file.read())


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(BYTE_BPE_FILE, "rb") as file:
        return byte_bpe.round_trip(_docs(spark, sf_dir), file.read(), public_tokenizers.PATTERN)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_docs(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_docs(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(WORD_BPE_FILE, encoding="utf-8") as file:
        return token_counts.count_tokens(_docs(spark, sf_dir), file.read())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.rearrange(_docs(spark, sf_dir)))


#: Phrases of each length are listed from word lists; an n-gram's parts are looked up in the same counts.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) AS sizes(k)),
counts AS (SELECT lang, k, w[i:i + k - 1] AS words, count(*) AS a FROM starts GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k >= 2 AND a >= 30),
inner_ones AS (
  SELECT lang, words[i:i + s - 1] AS words, max(a) AS most
  FROM (SELECT lang, words, a, k, s, unnest(range(1, k - s + 2)) AS i FROM candidates, (VALUES (2), (3)) AS sizes(s) WHERE s < k)
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_ones o ON c.lang = o.lang AND c.words = o.words
  WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * c.a),
cuts AS (SELECT lang, words, a, k, unnest(range(1, k)) AS cut FROM kept),
parts AS (
  SELECT t.lang, t.words, t.a, t.cut, f.a AS l, g.a AS r, ((2000000::HUGEINT * t.a) // (f.a + g.a))::BIGINT AS score
  FROM cuts t JOIN counts f ON f.lang = t.lang AND f.words = t.words[1:t.cut] JOIN counts g ON g.lang = t.lang AND g.words = t.words[t.cut + 1:t.k]),
weakest AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score
  FROM parts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

FILL_IN_MIDDLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (
  SELECT *, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM texts),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS x, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws),
parts AS (SELECT *, substring(text, 1, x) AS p, substring(text, x + 1, y - x) AS m, substring(text, y + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_pii, op3_quality, op4_secrets, op5_packing, op6_byte_bpe, op7_fingerprints, op8_toxicity,
        op9_embedding_dedup, op10_simhash_dedup, op11_token_counts, op12_collocations, op13_fill_in_middle,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": COLLOCATIONS_SQL, "op13_fill_in_middle": FILL_IN_MIDDLE_SQL}
