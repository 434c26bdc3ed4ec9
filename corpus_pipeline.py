"""A corpus from documents: toxic ones out, one of each near-duplicate group, no benchmark text, no secrets, sources mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kumiki.llm import decontaminate, jaccard_join, secret_scan, source_mix, toxicity
from kumiki.llm.tables import drop, drop_since, keep, kept, read
from kumiki.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, read(ship(spark), sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id stays."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, read(ship(spark), sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; n_chars follows where a text changed."""
    return secret_scan.mask_secrets(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken; repeated rows share one decision."""
    return source_mix.taken_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("mixing sources", mix),
]

#: The classifier and the masking cannot be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        mark = kept()
        docs, before = keep(stage(spark, docs, sf_dir), f"stage{k}"), docs
        drop_since(spark, mark, docs)
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
