"""What the classifiers share: a bounded sample of labelled rows, and scoring whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import text_rows

#: Features of a text: a sorted array of distinct feature numbers.
Extract = Callable[[pa.Array], "list[np.ndarray]"]


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, extract: Extract) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and 0/1 labels of at most ``rows`` labelled documents, those first by a hash of doc_id.

    Null labels and ids are passed over; of repeated labels the largest counts, of
    texts that repeat an id one, the same in every run.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(usable)
    chosen = named.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, y int")  # at most ``rows`` pairs

    def run(batches):
        for batch in batches:
            found = extract(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary())], names=["doc_id", "y", "f"])

    picked = text_rows(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    found = picked.mapInArrow(W.tidy(run), "doc_id long, y int, f binary")
    got = found.groupBy("doc_id").agg(F.min(F.struct("y", "f")).alias("r")).orderBy("doc_id").collect()
    return [np.frombuffer(r.r.f, np.int32) for r in got], np.array([r.r.y > 0 for r in got], dtype=np.float64)


def score_table(docs: DataFrame, held_out: Column, score: Callable[[pa.Array], np.ndarray], cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            s = np.asarray(score(batch.column(1)), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = text_rows(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return rows.mapInArrow(W.tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def per_text(column: pa.Array, bare: bool = False):
    """(bytes of the text, its word hashes) of each text."""
    for lo, hi, buf, offs in W.blocks(column):
        starts, ends, first = W.split(buf, offs, bare)
        h = W.hashes(buf, starts, ends)
        for i in range(hi - lo):
            yield buf[offs[i] : offs[i + 1]], h[first[i] : first[i + 1]], (ends - starts)[first[i] : first[i + 1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
