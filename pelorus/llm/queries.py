"""Registered queries: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pelorus.llm import bpe, embeddings, jaccard, langid, licenses, lines, media, mixing, secrets, toxicity
from pelorus.llm.common import held_out, read

RANKS = "byte_bpe_50k.tiktoken"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(read(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), decoded=True))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.text_media(read(spark, sf_dir, "documents")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(read(spark, sf_dir, "documents")))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(lines.dedup(read(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_bpe, op3_toxicity, op4_embeddings, op5_media, op6_licenses, op7_jaccard, op8_lines, op9_mixing, op10_langid)}

SQL: dict[str, str] = {"op9_mixing": mixing.SQL}
