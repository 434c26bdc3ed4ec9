"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free, keep

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one window of the prefix sums holds on average.
WINDOW_ROWS = 4096


def quality_weight(size: Column, n_chars: Column) -> Column:
    """A document's sampling weight: 1 at 3 to 12 characters a word, 0.5 otherwise."""
    return F.when((n_chars >= 3 * size) & (n_chars <= 12 * size), 1.0).otherwise(0.5)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size, n, target of ``sources(source, source_size, n)``.

    The k-th source by code point (null last) has the k-th of the repeated weights.
    ``share`` times all words are dealt by weight; a source stops at ``most`` times
    its own size and the rest is dealt anew.  That is one level for all sources
    below their stop: with the stops ordered by stop / weight, the first source
    that its level does not fill sets it.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    rows = sources.withColumn("w", F.get(cycle, ((F.row_number().over(named) - 1) % len(weights)).cast("int")))
    rows = rows.withColumn("stop", F.col("source_size") * most).withColumn("ratio", F.col("stop") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("w").over(after))
    rows = rows.withColumn("open", F.col("ratio") > F.col("level")).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("place"))).over(everything))
    return rows.select("source", "source_size", "n", F.when(F.col("open"), F.col("level") * F.col("w")).otherwise(F.col("stop")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, quality=quality_weight) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row of ``docs(doc_id, text, source)``.

    size counts the words of the text (null: 0).  Of each source all documents are
    taken once for every whole epoch that its target holds; the rest of the target
    is filled in the order of the exponential keys ``-ln(u) / quality``, u drawn from
    doc_id (a null one: from the text) and seed, up to the document whose end is nearest to it.  taken is
    copies times size.  Null sources are one source, last in order.  Repeated rows
    and equal doc_ids are separate documents that share u; ties go by doc_id, then
    by a hash of the text.  Empty texts have size 0 and take no words.  An empty
    table gives no row.  Prefix sums run in two levels, within key ranges of a
    source and over the ranges, so that no task holds a source.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.length(F.coalesce("text", F.lit(""))).alias("_chars"), F.xxhash64("text").alias("_tie"))
    rows = rows.withColumn("_key", -F.ln(uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("_tie").cast("string"))), seed)) / quality(F.col("size"), F.col("_chars")))
    rows = keep(rows.drop("_chars"), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = keep(source_targets(sources, weights, share, most), "targets")
    small = targets.count() <= 10_000  # rows of at most a name and three numbers
    join = lambda a, b, on: a.join(F.broadcast(b) if small else b, on).drop("_s")
    same = rows.source.eqNullSafe(F.col("_s"))
    rows = join(rows, targets.withColumnRenamed("source", "_s"), same)
    rows = rows.withColumn("_range", F.floor((1 - F.exp(-F.col("_key"))) * F.ceil(F.col("n") / WINDOW_ROWS)))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.sum("size").over(within))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    end = F.col("_ahead") + F.col("_upto")
    extra = (F.col("size") > 0) & (end - F.col("size") < rest) & ((end <= rest) | (end - rest < rest - (end - F.col("size"))))
    copies = epochs + F.when(extra, 1).otherwise(0)
    out = rows.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "_tie")


def taken_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes at least once, with size, source_size, target, copies, taken.

    Rows that repeat doc_id, text and source share the larger decision of theirs;
    columns of ``docs`` that have one of these names give way to the result's.
    """
    mixed = mix_sources(docs, **options).where("copies > 0")
    rows = docs.drop("size", "source_size", "target", "copies", "taken")
    x, i, t, s = free(rows, "_x", "_i", "_t", "_s")
    mixed = mixed.groupBy(F.col("doc_id").alias(i), F.col("_tie").alias(t), F.col("source").alias(s)).agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    rows = rows.withColumn(x, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(x) == F.col(t)) & F.col("source").cast("string").eqNullSafe(F.col(s))
    return rows.join(mixed, same).drop(x, i, t, s)
