"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of documents; the last returns
the mix: a row for each draw, with shard, epoch and order_key. Nulls in any column, empty and very long texts,
repeated rows, empty tables and further columns are treated as each operator's docstring says.

The verdicts of the first stage come from fitted models, which SQL cannot express, so ORACLE_SQL is None; the other
stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facteng.llm import decontaminate, linededup, mixing, neardup, toxicity
from facteng.llm.common import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on labels, takes for toxic go. Null and empty texts stay unless the base rate
    alone is toxic; repeated rows share their fate; without labels all stay."""
    return toxicity.keep_clean(docs, spark, toxicity.fit_from_tables(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go; all documents stay. Null texts stay null, repeated rows share their places."""
    return linededup.dedup_lines(docs, spark)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word shingle similarity of 0.8 or more stays, the one with the least doc_id
    (null last). Links are found by SimHash in the segment-popcount grid and checked exactly; what it misses is joined exactly. Null and empty texts are one group; of repeated rows one stays."""
    return neardup.one_of_each_group(docs, spark, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item go. Null and empty texts and items match nothing; repeated rows share
    their fate; without items all stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws of documents that bring the sources' words to their target weights. Null sources are one source, texts without words
    come with whole epochs only, repeated rows are drawn together."""
    return mixing.mix(docs, spark)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what a stage returns is written to the shared folder before the next begins."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
