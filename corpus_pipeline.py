"""From raw documents to a training mix, in stages that are written and reread one after another."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera_spark.llm import common, decontam, jaccard, line_dedup, mixing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, common.read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the document with the smallest id stays."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the times it takes each."""
    return mixing.mix_sources(docs, keep=docs.columns).where("copies > 0")


_scratch = common.Scratch()


def _stage(f):
    """f, after the scratch tables of the stage before have been deleted: its result has been written and reread by then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.release(spark)
        with _scratch:
            return f(spark, docs, sf_dir)

    return run_stage


#: Each takes (spark, docs, sf_dir); its result must be written before the next one is called.
STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("line_dedup", _stage(drop_repeated_lines)),
    ("jaccard_join", _stage(drop_near_copies)),
    ("decontamination", _stage(drop_leaks)),
    ("mixing", _stage(mix)),
]

#: The stages learn, join by similarity and solve a knapsack, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs
