"""The tokenizer on unbounded lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tokenizer import Tokenizer


def stream_tokens(lines: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Tokens of ``lines(value)``, stateless, so in append mode; doc_id is a digest of the line."""
    rows = lines.select(F.xxhash64("value").alias("doc_id"), F.lit(0).cast("long").alias("sent_id"), F.col("value").alias("text"))
    return tokenizer.transform(rows)


def stream_connid_counts(lines: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Running counts of connection ids, for complete or update mode."""
    return tokenizer.connid_counts(lines.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("sent_id"), F.col("value").alias("text")))
