"""SpotSigs fingerprints: chains of content words that follow common-word anchors."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import keep, text_rows

# Common words that anchor signatures, in English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i in is it its no not of on or our she so that the their them then there these they this to was we were what which who will with would you your "
    "aber als am an auf aus auch bei bis das dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von war wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en entre es esta este la las le lo los más me no nos o para pero por que se si sin su sus también un una y ya"
).split()
CHAIN = 2


def signatures(words: np.ndarray, common: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures: each anchor with the next ``chain`` content words.

    A text without such a chain has one signature of all its words, none without words.
    """
    if not len(words):
        return np.zeros(0, dtype=np.uint32)
    at = np.minimum(np.searchsorted(common, words), len(common) - 1)
    stop = common[at] == words
    content, anchors = np.flatnonzero(~stop), np.flatnonzero(stop)
    nxt = np.searchsorted(content, anchors)
    whole = nxt + chain <= len(content)
    anchors, nxt = anchors[whole], nxt[whole]
    if not len(anchors):
        return (W.grams(words, len(words)) >> np.uint64(32)).astype(np.uint32)
    h = words[anchors].copy()
    for j in range(chain):
        h = W.mix(h * np.uint64(3) + words[content[nxt + j]])
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def common_hashes() -> np.ndarray:
    return np.unique(W.hashes_of(ANCHORS))


def signature_sets(column: pa.Array, common: np.ndarray, chain: int = CHAIN) -> Iterator[np.ndarray]:
    for lo, hi, buf, offs in W.blocks(column):
        starts, ends, first = W.split(buf, offs, bare=True)
        h = W.hashes(buf, starts, ends)
        for i in range(hi - lo):
            yield signatures(h[first[i] : first[i + 1]], common, chain)


def text_of(s: np.ndarray) -> str:
    """The fingerprint as text: its length, then the signatures in hexadecimal."""
    return f"{len(s)}:{s.astype('>u4').tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two fingerprints, 0 at once if their lengths alone keep it under ``least``; two empty ones are alike."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


#: Stretches of neighbouring rows at most, rows of one at least, and sampled rows for each that place their bounds.
STRETCHES, STRETCH_ROWS, SAMPLED = 4096, 2048, 32


def _bounds(rows: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, tie) of rows that cut all rows into stretches of about equal numbers, by a sample of bounded size; a null id is the least."""
    n = rows.count()
    parts = min(STRETCHES, math.ceil(n / STRETCH_ROWS))
    if parts < 2:
        return []
    every = max(1, n // (SAMPLED * parts))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit(1)), F.lit(every)) == 0).groupBy("doc_id", "tie").count().collect()
    keys = sorted((_LEAST if r.doc_id is None else r.doc_id, r.tie) for r in sample)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


_LEAST = -(1 << 63)


def _with_next(rows: DataFrame) -> DataFrame:
    """Rows (b, doc_id, tie, text, closing): stretches b of the order, each closed by a copy of the row that follows it, the last by the first."""
    spark, rows = rows.sparkSession, rows.withColumn("tie", F.xxhash64("text"))
    edges = spark.sparkContext.broadcast(_bounds(rows.select("doc_id", "tie")))

    def stretch(batches):
        bounds = edges.value
        firsts = np.array([i for i, _ in bounds], dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(_LEAST).to_numpy(zero_copy_only=False)
            b = np.searchsorted(firsts, ids, side="right")
            # rows of an id that a bound has are placed by their ties
            for k in np.flatnonzero(np.isin(ids, firsts)).tolist():
                b[k] = bisect.bisect_right(bounds, (int(ids[k]), batch.column(2)[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), *batch.columns], names=["b", *batch.schema.names])

    placed = rows.select("doc_id", "text", "tie").mapInArrow(W.tidy(stretch), "b int, doc_id long, text string, tie long")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    heads = keep(placed.groupBy("b").agg(F.min_by(F.struct("doc_id", "tie", "text"), order).alias("head")), "heads")
    used = sorted(r.b for r in heads.select("b").collect())  # at most STRETCHES numbers
    if not used:
        return placed.withColumn("closing", F.lit(0)).limit(0)
    before = spark.createDataFrame(list(zip(used, [used[-1], *used[:-1]])), "b int, p int")
    closing = heads.join(F.broadcast(before), "b").select(F.col("p").alias("b"), "head.doc_id", "head.text", "head.tie", F.lit(1).alias("closing"))
    return placed.withColumn("closing", F.lit(0)).unionByName(closing)


def spot_fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Texts are null-safe (null: empty).  The edited text replaces the last
    floor(n_chars / 2) code points by the first as many (or all) of the next row's
    text in the order of doc_id, null first, then of a hash of the text; after the
    last comes the first, so a single row follows itself.  Equal texts have equal
    fingerprints; a text without words has the empty one, "0:".  An empty table
    gives no row.  Rows move once, in stretches of neighbouring ids, and stream
    through a task.
    """
    rows = text_rows(docs)
    common = common_hashes()

    def run(batches):
        last, out = None, []

        def sets(texts):
            return list(signature_sets(pa.array(texts, pa.large_string()), common, chain))

        def emit(rows):
            """Rows but the last, each with the one after it."""
            halves = [len(t) // 2 for _, t, _, _ in rows]
            here = sets([t for _, t, _, _ in rows])
            edited = [rows[i][1][: len(rows[i][1]) - halves[i]] + rows[i + 1][1][: halves[i]] for i in range(len(rows) - 1)]
            there = sets(edited)
            got = [(rows[i][0], len(rows[i][1]), hashlib.sha256(edited[i].encode()).hexdigest(), text_of(here[i]), text_of(there[i]), likeness(here[i], there[i]), likeness(here[i], here[i + 1])) for i in range(len(rows) - 1) if rows[i][2] == rows[i + 1][2] and not rows[i][3]]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, g)) for g in got], schema=schema)

        held, size = [], 0
        for batch in batches:
            for b, i, t, closing in zip(*(batch.column(c).to_pylist() for c in ("b", "doc_id", "text", "closing"))):
                held.append((i, t, b, closing))
                size += len(t)
                if len(held) > 1 and (size > W.BLOCK_BYTES or len(held) > 512):
                    yield emit(held)
                    held, size = held[-1:], len(t)
        if len(held) > 1:
            yield emit(held)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    order = _with_next(rows).repartition("b").sortWithinPartitions("b", "closing", F.col("doc_id").asc_nulls_first(), "tie")
    return order.mapInArrow(W.tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def spot_near_pairs(docs: DataFrame, least: float = 0.75, chain: int = CHAIN) -> DataFrame:
    """(a, b, likeness): representatives of different fingerprints that are alike by ``least`` or more.

    Fingerprints are partitioned by set length: lengths that cannot reach ``least``
    never share a partition, and each set enters its own and the next longer one.
    Within a partition candidates share one of the rarest signatures that a likeness
    of ``least`` cannot do without; Jaccard of the whole sets is then exact.
    Rows without words pair with nothing.  a and b are the smallest doc_ids.
    """
    rows, common = text_rows(docs), common_hashes()

    def run(batches):
        for batch in batches:
            found = list(signature_sets(batch.column(1), common, chain))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    sets = rows.where("doc_id is not null").mapInArrow(W.tidy(run), "doc_id long, sigs array<long>").where(F.size("sigs") > 0)
    sets = keep(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")), "spots")
    n = F.size("sigs")
    df = sets.select(F.explode("sigs").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    ranked = sets.select("doc_id", n.alias("n"), F.explode("sigs").alias("g")).join(df, "g")
    order = Window.partitionBy("doc_id").orderBy("df", "g")
    front = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).where("df > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(least)).cast("int")
    front = front.withColumn("band", F.explode(F.array(band, band + 1))).select("doc_id", "n", "g", "band")
    a, b = front.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "g", "band"), front.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "g", "band")
    pairs = a.join(b, ["g", "band"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").distinct()
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).where(F.col("likeness") >= least)
