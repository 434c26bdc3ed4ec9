"""Connection costs: a matrix, a sum over feature templates, or both; remapping of connection ids."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument

DUAL_RAW = 8


def matrix_cost(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Adds cost to ``pairs(right_id, left_id)``; absent cells cost 0."""
    return pairs.join(costs, ["right_id", "left_id"], "left").withColumn("cost", F.coalesce("cost", F.lit(0)))


def raw_cost(pairs: DataFrame, right_feats: DataFrame, left_feats: DataFrame, pair_cost: DataFrame) -> DataFrame:
    """Adds cost: the sum over templates k of the cost of (right feature, left feature), absent ones 0."""
    r = right_feats.select(F.col("id").alias("right_id"), "k", F.col("feat").alias("rf"))
    left = left_feats.select(F.col("id").alias("left_id"), "k", F.col("feat").alias("lf"))
    hit = pairs.distinct().join(r, "right_id").join(left, ["left_id", "k"]).join(pair_cost, ["rf", "lf"])
    total = hit.groupBy("right_id", "left_id").agg(F.sum("cost").cast("int").alias("cost"))
    return matrix_cost(pairs, total)


def scored_cost(pairs: DataFrame, dictionary) -> DataFrame:
    """Adds cost to distinct ``pairs(right_id, left_id)`` by a packed dictionary (a broadcast): only the pairs given are scored."""

    def run(batches):
        index = dictionary.value.open()
        for batch in batches:
            right, left = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.conn(left, right).astype(np.int32))], names=["right_id", "left_id", "cost"])

    return pairs.select("right_id", "left_id").distinct().mapInArrow(run, "right_id int, left_id int, cost int")


def _row_hashes(features: DataFrame, side: str, keys: list[int]) -> DataFrame:
    """(side, h): for each id the hashes of its features by template, in order of ``keys``; one of its own where it has none."""
    rows = features.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "feat"))).alias("m"))
    return rows.select(F.lit(side).alias("side"), F.array(*[F.xxhash64(F.lit(k), F.try_element_at("m", F.lit(k))) for k in keys]).alias("h"))


def split_templates(right_feats: DataFrame, left_feats: DataFrame, raw: int = DUAL_RAW) -> list[int]:
    """The ``raw`` templates that stay factored: one after another, the one without which the fewest distinct rows remain; ties take the highest index.

    A row's hash is that of all its features together, so without a template it is that hash less the
    template's part: one aggregate a round counts the distinct rows for every candidate, and
    only these counts are collected.
    """
    keys = sorted(r.k for r in right_feats.select("k").unionAll(left_feats.select("k")).distinct().collect())
    if len(keys) < raw:
        raise InvalidArgument(f"at least {raw} templates are needed")
    rows = _row_hashes(right_feats, "right", keys).unionAll(_row_hashes(left_feats, "left", keys)).persist()
    out, rest = [], list(range(len(keys)))
    for _ in range(raw):
        whole = reduce(lambda a, b: a.bitwiseXOR(b), [F.get("h", F.lit(i)) for i in rest])
        without = F.array(*[F.struct(F.lit(i).alias("i"), whole.bitwiseXOR(F.get("h", F.lit(i))).alias("h")) for i in rest])
        counts = rows.select("side", F.explode(without).alias("c")).groupBy("side", "c.i").agg(F.count_distinct("c.h").alias("n")).collect()
        size = {(r.side, r.i): r.n for r in counts}
        worst = min(rest, key=lambda i: (size.get(("right", i), 0) * size.get(("left", i), 0), -i))  # noqa: B023
        out.append(keys[worst])
        rest.remove(worst)
    rows.unpersist()
    return sorted(out)


def summed(right_feats: DataFrame, left_feats: DataFrame, pair_cost: DataFrame) -> DataFrame:
    """(right_id, left_id, cost) of every pair of ids whose templates cost something: the sum over them."""
    r = right_feats.select(F.col("id").alias("right_id"), "k", F.col("feat").alias("rf"))
    left = left_feats.select(F.col("id").alias("left_id"), "k", F.col("feat").alias("lf"))
    return r.join(pair_cost, "rf").join(left, ["k", "lf"]).groupBy("right_id", "left_id").agg(F.sum("cost").alias("cost"))


def dense_matrix(right_feats: DataFrame, left_feats: DataFrame, pair_cost: DataFrame) -> DataFrame:
    """The sums clamped to 16 bits."""
    return summed(right_feats, left_feats, pair_cost).select("right_id", "left_id", F.least(F.greatest("cost", F.lit(-32768)), F.lit(32767)).cast("int").alias("cost"))


def dual_matrix(right_feats: DataFrame, left_feats: DataFrame, pair_cost: DataFrame, raw_templates: list[int]) -> DataFrame:
    """(right_id, left_id, cost) of every pair of ids by ``dual_cost``, without the pairs that cost nothing."""
    inside = F.col("k").isin(raw_templates)
    parts = dense_matrix(right_feats.where(~inside), left_feats.where(~inside), pair_cost).unionByName(summed(right_feats.where(inside), left_feats.where(inside), pair_cost))
    return parts.groupBy("right_id", "left_id").agg(F.sum("cost").cast("int").alias("cost"))


def dual_cost(pairs: DataFrame, right_feats: DataFrame, left_feats: DataFrame, pair_cost: DataFrame, raw_templates: list[int]) -> DataFrame:
    """Matrix cost over the other templates plus raw cost over ``raw_templates``."""
    inside = F.col("k").isin(raw_templates)
    dense = dense_matrix(right_feats.where(~inside), left_feats.where(~inside), pair_cost)
    used = pair_cost.join(right_feats.where(inside).select(F.col("feat").alias("rf")).distinct(), "rf", "left_semi").join(left_feats.where(inside).select(F.col("feat").alias("lf")).distinct(), "lf", "left_semi")
    raw = raw_cost(pairs, right_feats.where(inside), left_feats.where(inside), used).withColumnRenamed("cost", "raw")
    return matrix_cost(raw, dense).select("right_id", "left_id", (F.col("cost") + F.col("raw")).cast("int").alias("cost"))


def permutation(order: DataFrame, size: int) -> DataFrame:
    """(old_id, new_id) of all ids, 0 staying 0; ``order`` must name each id from 1 to size - 1 once."""
    row = order.agg(F.count("*"), F.count_distinct("old_id"), F.min("old_id"), F.max("old_id")).first()
    if tuple(row) != (size - 1, size - 1, 1, size - 1) and size > 1:
        raise InvalidArgument("a mapping names every id but 0 once")
    return order.select("old_id", "new_id").unionAll(order.sparkSession.createDataFrame([(0, 0)], "old_id int, new_id int"))


def remap(df: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """``df`` with left_id and right_id renamed; the rest is unchanged."""
    for column, mapping in (("left_id", left), ("right_id", right)):
        if mapping is not None:
            new = F.broadcast(mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("_new")))
            df = df.join(new, column).withColumn(column, F.col("_new")).drop("_new").select(*df.columns)
    return df


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """One mapping after another."""
    return first.join(second.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_n")), "new_id").select("old_id", F.col("_n").alias("new_id"))
