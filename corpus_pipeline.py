"""A corpus from documents: quality filter, exact dedup, near dedup, mixing, token pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes every stage's result into the shared folder and reads it again, so a lost executor costs one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, mixing, near_dup, pieces, quality, queries
from cairn.llm.common import stash

#: Least probability of good quality with which a document stays.
LEAST_GOOD = 0.5
#: Shares of tokens by domain among the good documents. The mix has as many tokens as they allow, so the scarcest domain stays.
TARGETS = {"good": 0.97, "good_toxic": 0.03}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier (operator 7) rates as good go on."""
    model = quality.train(docs, _labels(spark, sf_dir), F.expr(queries.GRADE), queries.GRADES)
    return quality.select(docs, model, above=0, least=LEAST_GOOD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id goes on (operator 10)."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more, the smallest doc_id goes on (operator 8)."""
    return near_dup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are kept at rates for which the expected tokens of each domain match the targets (operator 2)."""
    model = mixing.train(docs, _labels(spark, sf_dir), F.expr(queries.DOMAIN), list(TARGETS))
    _, solution = mixing.mix(docs, model, list(TARGETS.values()))
    return mixing.realise(docs, model, solution)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of its pieces, and digests of them and of the text they decode to (operator 9)."""
    return pieces.encode(docs, queries.vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", sentence_pieces),
]

#: SQL can express neither the classifiers nor the pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
