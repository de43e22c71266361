"""Queries of the text operators, their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ctw, exact_dedup, hard_negatives, mixing, mpeg, near_dup, pieces, quality, simhash, substring_dedup, token_output, toxicity, whitening


def vocabulary(name: str) -> str:
    """Where the public vocabularies lie on every machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.read_back(mpeg.store_texts(_documents(spark, sf_dir)))


#: Domains that the labels give, and their shares of the tokens of a mix.
DOMAIN = "CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 1 AND toxic = 1 THEN 'good_toxic' WHEN quality = 0 AND toxic = 0 THEN 'poor' WHEN quality = 0 AND toxic = 1 THEN 'poor_toxic' END"
TARGETS = {"good": 0.9, "good_toxic": 0.04, "poor": 0.055, "poor_toxic": 0.005}
#: Tokens of the mix as a share of all tokens.
BUDGET = 0.8


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = mixing.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(DOMAIN), list(TARGETS))
    rated, _ = mixing.mix(docs, model, list(TARGETS.values()), BUDGET)
    return rated.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_documents(spark, sf_dir), remainder(7) == 2)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_documents(spark, sf_dir))


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(remainder(5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(remainder(5) == 0, F.lit(False)))


#: Ratings that the labels give: 0 low quality, 1 good but toxic, 2 good.
GRADE, GRADES = "CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END", 3


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(GRADE), GRADES)
    return quality.score(docs, model).select("doc_id", "expected_grade", F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_clean"), (F.col("tails")[0] >= 0.5).alias("kept"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_join(_documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(_embeddings(spark, sf_dir), F.expr("vec_id % 50 = 0"), label=label)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(_documents(spark, sf_dir)).drop("group_size")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_embeddings(spark, sf_dir))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1, what SQL can say: the payload that was read back from the stored frames."""
    return op1_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents), n AS (SELECT *, octet_length(t) AS n FROM b), p AS (SELECT *, CAST(greatest(1, ceil(n / 576)) AS BIGINT) * 576 AS m FROM n)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat('\xFF'::BLOB, m - n)) AS payload_sha256 FROM p
"""


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3, what SQL can say: tokens and the add-one base."""
    return op3_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


#: crc32 by its bits: DuckDB has none.
LM_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id, s, 0 AS i, 4294967295::BIGINT AS r FROM ids
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(r, ascii(s[i // 9 + 1])) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM c WHERE i < 9 * length(s)),
h AS (SELECT doc_id, xor(r, 4294967295) % 7 = 2 AS held_out FROM c WHERE i = 9 * length(s)),
t AS (SELECT row_number() OVER () AS k, d.doc_id, coalesce(h.held_out, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), '') AS w FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id),
e AS (SELECT k, held_out, unnest(w) AS w FROM t), n AS (SELECT w, count(*) AS c FROM e WHERE NOT held_out GROUP BY w), v AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM n),
s AS (SELECT k, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base FROM e LEFT JOIN n USING (w) CROSS JOIN v GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM v) AS train_tokens, round(base, 3) AS base_score FROM t JOIN s USING (k)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_mixing": op2_mixing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_output": op4_token_output,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
    "media_payload": media_payload,
    "lm_base": lm_base,
}
ORACLES: dict[str, str] = {"op8_jaccard_join": near_dup.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "media_payload": MEDIA_SQL, "lm_base": LM_SQL}
