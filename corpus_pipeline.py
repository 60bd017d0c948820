"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard, mixing, BPE.

Counted as part of the subpackage ``llm``.  Each stage takes (spark, docs,
sf_dir), is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm import bpe, jaccard, lines, mixing, toxicity
from pelorus.llm.common import Scratch, join_counted, pick, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; those with null ids or texts stay."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_harmless(pick(docs, *COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that had text and have no visible line left, which are copies throughout."""
    out = lines.dedup(pick(docs, *COLUMNS))
    return out.where("dropped_lines is null or trim(both '\\n\\t\\r ' from text) <> ''").withColumn("n_chars", F.when(F.col("dropped_lines").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, similarity 0.8."""
    return jaccard.keep_one(pick(docs, *COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = pick(docs, *COLUMNS)
    plan = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("copies"))
    plan = Scratch(spark).save(plan.where("copies > 0"))
    taken = join_counted(docs, plan, docs.doc_id.eqNullSafe(F.col("_id")), "inner")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: The first stages are learned or iterative; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = Scratch(spark).save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
