"""From raw documents to token ids, in stages that each read what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boletim.llm import chunk_reuse, compression_toxicity, factorisation, pfair_mix, setsketch
from boletim.llm.common import new_path, ship, table


#: Percent of the union of their runs of five words from which documents are near duplicates here.
NEAR = 80


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression distance doesn't hold toxic."""
    detector = compression_toxicity.fit_toxicity(docs, table(ship(spark), sf_dir, "labels"))
    return compression_toxicity.filter_documents(docs, detector)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorisation machine holds good."""
    machine = factorisation.fit_quality(docs, table(ship(spark), sf_dir, "labels"))
    return factorisation.filter_documents(docs, machine)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return setsketch.one_of_each(docs, NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix of sources, which the files keep."""
    ship(spark)
    return pfair_mix.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document."""
    ship(spark)
    return chunk_reuse.digests(docs)


STAGES = [
    ("toxicity", ordinary),
    ("quality classifier", good),
    ("near duplicates", one_of_each),
    ("source mix", mixed),
    ("BPE encoding", encoded),
]

#: Models, likelihoods and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            path = new_path(spark, f"stage-{at}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
