"""The corpus pipeline: quality rules, line deduplication, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first three return the columns of
documents; the last fills sequences and returns their pieces with the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, line_dedup, packing, quality
from plumbline.llm.common import WHITESPACE, discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host does, go."""
    return quality.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Similar lines go but one, n_chars follows the text. A document that so loses its last word goes: all that it said stands in
    others. One that had no words before stays."""
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.col("removed_lines") == 0) | (F.translate("text", WHITESPACE, "") != ""))
    return out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similar word shingles link, the one with the least id stays."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences in its sources' proportions."""
    import public_tokenizers

    return packing.pieces_of(packing.sequences(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", near_duplicates), ("packing", pack)]

#: Tokenization and fuzzy matching can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
