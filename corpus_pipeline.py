"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krigmesh.llm.common import Scratch, table
from krigmesh.llm.decontaminate import drop_contaminated
from krigmesh.llm.ngram_join import keep_one
from krigmesh.llm.packing import pack_documents
from krigmesh.llm.suffix_dedup import drop_repeats
from krigmesh.llm.toxicity import drop_toxic

#: Bytes of a repeated passage: below the length of 50 words of prose.
REPEATED_BYTES = 200


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of the five-word shingles, the smallest key stays."""
    return keep_one(spark, docs, n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start more than once are cut out; all documents stay, and n_chars follows the text."""
    out = drop_repeats(spark, docs, length=REPEATED_BYTES)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in out.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids and the sequences that hold them."""
    return pack_documents(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: A classifier, connected components and a packer are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
