"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept.

The stages drop toxic documents, drop repeated lines, keep one document of each class of near copies, drop documents
that hold a benchmark item, and pack the tokens of the rest. All but the last return the columns of documents.

Rows with a null id or text go through all stages by the rules that the operators state: a null text is clean, one empty
line, one of the class of texts without words, and one end id; a row with a null id links to nothing. Repeated rows become
one in near dedup. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornwall.llm import decontam, lines, packing, simhash, toxicity
from thornwall.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go. The network learns from all labels that the folder has."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, threshold=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more that several documents hold stay in the first only; n_chars follows the text."""
    return lines.deduplicate_lines(docs, min_chars=10).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: three-word shingles, fingerprints at most 3 bits apart."""
    return simhash.deduplicate(docs, words=3, radius=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: five-word shingles, a similarity of 0.8 or more."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=5, least=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 1024 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The network, the fingerprints and the linear program have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
