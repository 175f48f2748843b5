"""Five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before kept, and returns a frame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spreadgraph.llm.exact import drop_copies
from spreadgraph.llm.mixing import mix_sources
from spreadgraph.llm.near import drop_near_duplicates
from spreadgraph.llm.packing import pack_documents
from spreadgraph.llm.toxicity import drop_toxic, train
from spreadgraph.storage import keep


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorization machine, fitted on the labelled ones, does not reject.

    Null and empty texts score as the machine's bias; without labels of both kinds nothing is told apart. Repeated rows go or stay
    together. An empty table stays empty; extra columns stay, whatever their names (so in all stages but the last).
    """
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id.

    Null texts equal empty ones; null ids lose against any other; of rows repeated with the winner's id one stays. An empty table stays empty.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id.

    Null, empty and blank texts have no shingles, link with nothing and stay; null ids lose against any other; of repeated rows one
    stays. An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to source shares of mass ** 0.5, in a global random order.

    A null source is the source of the empty name; null and empty texts have a mass of 1; null ids share one count; rows with equal ids
    have equal counts. An empty table stays empty.
    """
    return mix_sources(docs).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence of at most 2048 tokens.

    Null and empty texts are their end token; repeated rows are packed each; extra columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: No SQL: the first stage applies a fitted model. ``tests/llm/test_pipeline.py`` checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
