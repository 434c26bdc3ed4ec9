"""Phrases that stand together, by hierarchical naming of adjacent frequent phrases.

A phrase of k words is named by the pair of the names of its first and its last k - 1
words.  Each level counts the pairs of adjacent frequent phrases of the level below over
all texts; the pairs that stay carry their two parents' names, along which the counts of
all beginnings and endings, the words, and the longer phrases that hold a phrase are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import drop_since, keep, kept

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of the filter that tells tasks which phrases may be frequent: its size whatever the input's.  A phrase that it lets
#: through in error is counted and then dropped, so the filter saves work and decides nothing.
FILTER_BITS = 1 << 26
#: Names a task collects before it adds up equal ones.
BUFFER = 1 << 20
_U = np.uint64
#: Bytes that end pieces, and those that end words.
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _STOP.copy()
_GAP[[9, 32]] = True


def _tokens(column: pa.Array, langs: pa.Array, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, word starts, word ends, names, language of each word, whether the next word is in the same piece) of blocks of texts.

    Names of words depend on the language, the lower-cased word and the seed.
    """
    kinds = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    salt = W.mix(W.hashes_of([x or "" for x in kinds.dictionary.to_pylist()]) + _U(seed) * _U(0x9E3779B97F4A7C15)) if len(kinds.dictionary) else np.zeros(0, np.uint64)
    kind = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, _, buf, offs in W.blocks(column):
        if not len(buf):
            continue
        ink = ~_GAP[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offs] = True
        starts = np.flatnonzero(ink & (np.concatenate(([True], ~ink[:-1])) | edge[:-1]))
        ends = np.flatnonzero(ink & (np.concatenate((~ink[1:], [True])) | edge[1:])) + 1
        if not len(starts):
            continue
        doc = np.searchsorted(offs, starts, side="right") - 1
        piece = np.cumsum(_STOP[buf], dtype=np.int64)[starts]
        joined = np.append((doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]), False)
        lang = kind[lo + doc]
        yield buf, starts, ends, W.mix(W.hashes(buf, starts, ends) ^ salt[lang]), lang, joined


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs: for one left name, different right names give different ones."""
    return W.mix(left * _U(0xD6E8FEB86659FD93) + right)


class _Sums:
    """Counts by key (one or two numbers), added up when many have gathered."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.many += len(columns[0])

    def taken(self) -> tuple[np.ndarray, ...]:
        """(keys..., extra column of the first, count) and an empty start."""
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.many = [], 0
        *keys, count = columns
        order = np.lexsort(keys[::-1])
        keys, count = [k[order] for k in keys], count[order]
        first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
        return *(k[first] for k in keys), np.add.reduceat(count, first)

    def full(self) -> bool:
        """Whether to hand out: adds up first, and goes on if that shrank the buffer by half."""
        if self.many < BUFFER:
            return False
        done = self.taken()
        self.add(*done)
        return self.many > BUFFER // 2


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _words(seed: int):
    """(text, lang) to (id, lang, word, cnt): every word, lower-cased, with its count in some texts."""

    def run(batches):
        seen: dict[int, tuple[str, str]] = {}
        sums = _Sums()

        def out():
            ids, count = sums.taken()
            said = [seen[i] for i in ids.tolist()]
            seen.clear()
            return pa.RecordBatch.from_arrays([_long(ids), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.string()), pa.array(count)], names=["id", "lang", "word", "cnt"])

        for batch in batches:
            names = pc.fill_null(batch.column(1).cast(pa.string()), "und").dictionary_encode().dictionary.to_pylist()
            for buf, starts, ends, ids, lang, _ in _tokens(batch.column(0), batch.column(1), seed):
                u, at, count = np.unique(ids, return_index=True, return_counts=True)
                raw = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8).tobytes()
                for i, a, b, k in zip(u.tolist(), starts[at].tolist(), ends[at].tolist(), lang[at].tolist()):
                    if i not in seen:
                        seen[i] = names[k], raw[a:b].decode()
                sums.add(u, count)
                if sums.full() or len(seen) > BUFFER // 4:
                    yield out()
        if sums.many:
            yield out()

    return run


class _Filter:
    """Which names may be frequent, level by level: one bit for each of FILTER_BITS cells."""

    def __init__(self, bits: int):
        self.bits, self.levels = bits, []

    def add(self, rows: DataFrame) -> None:
        """Bits of the names in ``rows(id)``; at most bits / 64 numbers come to the driver."""
        cell = F.pmod(F.shiftrightunsigned("id", 1), F.lit(self.bits))
        words = rows.groupBy(F.floor(cell / 64).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(shiftrightunsigned(id, 1), 64L)))")).alias("w"))
        out = np.zeros(self.bits // 64, dtype=np.uint64)
        got = words.toArrow()
        out[got.column("k").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
        self.levels.append(out)

    def has(self, level: int, ids: np.ndarray) -> np.ndarray:
        cell = (ids >> _U(1)) % _U(self.bits)
        return (self.levels[level][(cell >> _U(6)).astype(np.int64)] >> (cell & _U(63))) & _U(1) > 0


def _pairs(known, seed: int):
    """(text, lang) to (l, r, cnt): adjacent names of the last level that ``known`` (a broadcast _Filter) has, with their counts in some texts."""

    def run(batches):
        sums = _Sums()
        out = lambda: pa.RecordBatch.from_arrays([_long(c) for c in sums.taken()], names=["l", "r", "cnt"])
        for batch in batches:
            for _, _, _, ids, _, joined in _tokens(batch.column(0), batch.column(1), seed):
                at = np.flatnonzero(known.value.has(0, ids))
                for level in range(len(known.value.levels)):
                    if level:
                        names = _pair(ids[at], ids[at + 1])
                        ids = ids.copy()
                        ids[at] = names
                        at = at[known.value.has(level, names)]
                    ok = np.zeros(len(ids) + 1, dtype=bool)
                    ok[at] = True
                    at = at[ok[at + 1] & joined[at]]  # the phrase that starts one word later is known too, in the same piece
                if len(at):
                    sums.add(ids[at], ids[at + 1], np.ones(len(at), dtype=np.int64))
                    if sums.full():
                        yield out()
        if sums.many:
            yield out()

    return run


def _frequent_words(rows: DataFrame, least: int):
    """(lang, n) and the frequent words (id, lang, word, cnt), with the seed under which no word shares a frequent one's name."""
    for seed in range(1, 9):
        counted = rows.mapInArrow(W.tidy(_words(seed)), "id long, lang string, word string, cnt long")
        by = counted.groupBy("id").agg(F.sum("cnt").alias("cnt"), F.min("word").alias("word"), F.max("word").alias("other"), F.min("lang").alias("lang"), F.max("lang").alias("tongue"))
        # rare words leave their counts only
        by = by.select(F.when(F.col("cnt") >= least, F.col("id")).alias("id"), "lang", F.when(F.col("cnt") >= least, F.col("word")).alias("word"), "cnt", ((F.col("word") != F.col("other")) | (F.col("lang") != F.col("tongue"))).alias("mixed"))
        some = keep(by.groupBy("lang", "id", "word").agg(F.sum("cnt").alias("cnt"), F.max("mixed").alias("mixed")), "words", narrow=True)
        if some.where("id IS NOT NULL AND mixed").isEmpty():
            return some.groupBy("lang").agg(F.sum("cnt").alias("n")), some.where("id IS NOT NULL").select("id", "lang", "word", "cnt"), seed
    raise ArithmeticError("words share names under every seed")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of ``docs(text, lang)``.

    Texts are lower-cased in A-Z and cut into pieces at ``. , ; : ! ?`` and line
    ends, pieces into words at spaces and tabs; a null text is empty, a null lang is
    ``und``.  Of phrases of 2 to ``longest`` words with a >= ``least`` occurrences
    (overlapping ones count), each cut into a beginning of l and a rest of r
    occurrences scores floor(1000 * a * n / (l * r)), n being the words of the
    language; the lowest cut counts, of equal ones that after the fewest words.  A
    phrase inside a longer one that occurs as often is left out.  Order: score, then a,
    falling, then the phrase by bytes.  Arithmetic is in 38 digits.

    Rows count as often as they occur, whatever their ids.  An empty table and a
    language without a frequent phrase give no row.  Texts of any length are read whole.
    """
    spark, mark = docs.sparkSession, kept()
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes, words, seed = _frequent_words(rows, least)
    level = words.select("id", "lang", F.lit(None).cast("long").alias("lid"), F.lit(None).cast("long").alias("rid"), "cnt", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("cnt").alias("heads"), F.array("cnt").alias("tails"))
    known, found = _Filter(bits), []
    for k in range(2, longest + 1):
        known.add(level)
        shared = spark.sparkContext.broadcast(known)  # bits / 8 bytes a level
        counted = rows.mapInArrow(W.tidy(_pairs(shared, seed)), "l long, r long, cnt long").groupBy("l", "r").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= least)
        named = counted.select(F.col("l").alias("lid"), F.col("r").alias("rid"), "cnt")
        left = level.select(F.col("id").alias("lid"), "lang", "phrase", "heads")
        right = level.select(F.col("id").alias("rid"), "last", "tails")
        grown = named.join(left, "lid").join(right, "rid")
        level = keep(grown.select(
            "lid", "rid", "lang", "cnt", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
            F.concat("heads", F.array("cnt")).alias("heads"), F.concat("tails", F.array("cnt")).alias("tails"),
        ).mapInArrow(_with_names, "id long, lid long, rid long, lang string, cnt long, phrase string, last string, heads array<bigint>, tails array<bigint>"), f"phrases{k}")
        found.append(level)
        if level.isEmpty():
            break
        if not level.groupBy("id").count().where("count > 1").isEmpty():
            raise ArithmeticError("two phrases share a name")
    kept_ones = []
    for shorter, longer in zip(found, [*found[1:], None]):
        if longer is not None:  # longer phrases that occur as often are those one word longer
            inside = longer.select(F.explode(F.array("lid", "rid")).alias("id"), "cnt").distinct()
            shorter = shorter.join(inside, ["id", "cnt"], "left_anti")
        kept_ones.append(shorter.select("lang", "phrase", "cnt", "heads", "tails"))
    rows = kept_ones[0]
    for more in kept_ones[1:]:
        rows = rows.unionAll(more)
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang")
    wide = lambda c: c.cast("decimal(38,0)")
    cuts = F.transform(F.sequence(F.lit(1), F.size("heads") - 1), lambda k: F.struct(k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.size("heads") - k - 1).alias("r")))
    # the lowest floor(1000 a n / (l r)), then the fewest words: whole numbers all the way
    rows = rows.select("lang", "phrase", F.col("cnt").alias("a"), "n", F.explode(cuts).alias("c"))
    rows = rows.withColumn("score", F.expr("cast(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0)))"))
    rows = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "c.k", "c.l", "c.r")).alias("c"))
    best = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = keep(rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("long").alias("score")), "collocations", narrow=True)
    drop_since(spark, mark, out)
    return out


def _with_names(batches):
    for batch in batches:
        left, right = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([_long(_pair(left, right)), *batch.columns], names=["id", *batch.schema.names])
