"""Training corpus from raw documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopgraph.llm.common import table
from hopgraph.llm.decontaminate import drop_contaminated
from hopgraph.llm.pack import pack, public_paths
from hopgraph.llm.quality import drop_low_quality, train
from hopgraph.llm.repeats import drop_repeats
from hopgraph.llm.resemblance import drop_resembling
from hopgraph.plans.scratch import Scratch

#: Bits in which the SimHash fingerprints of near duplicates differ at most.
RADIUS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quadratic discriminant does not reject."""
    return drop_low_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are linked by their SimHash fingerprints (at most
    ``RADIUS`` differing bits) or have 0.8 and more of their five-word shingles in common."""
    return drop_resembling(docs, radius=RADIUS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of 200 bytes and more stay in the first place they come."""
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences and offsets."""
    return pack(docs, *public_paths())


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: Suffix orders, tokens and linear programs are beyond SQL; tests/llm has the brute-force version.
ORACLE_SQL = None
SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return docs
