"""Repeated passages by a sparse suffix array: suffixes at minimiser positions, sorted, compared with their neighbours, extended both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import drop, keep

#: Words of the shortest reported passage, and of the key of a suffix.
LEAST, KEY = 50, 25


def minimisers(h: np.ndarray, least: int = LEAST, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the kept suffixes, their keys, and the fewest and the most words that precede them in a run that keeps them.

    Of the ``least - key + 1`` keys of every run of ``least`` words the smallest is kept.
    The choice depends on the words of the run alone, so equal runs keep the same suffix.
    """
    n = len(h)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, width = W.grams(h, key), least - key + 1
    low = np.uint64(max(8, int(len(g)).bit_length()))
    packed = ((g >> low) << low) | np.arange(len(g), dtype=np.uint64)
    reach, best = 1, packed
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    kept = (best & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)  # for each run; never falls
    first = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1])))
    at = kept[first]
    return at, g[at], at - np.append(first[1:] - 1, len(kept) - 1), at - first


def _texts(column):
    for lo, hi, buf, offs in W.blocks(column):
        starts, ends, first = W.split(buf, offs)
        h = W.hashes(buf, starts, ends, fold=False)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            yield lo + i, h[a:b], buf, offs[i], starts[a:b], ends[a:b]


def _suffix_keys(least, key):
    def run(batches):
        for batch in batches:
            out, ids = [[] for _ in range(5)], batch.column(0).to_numpy(zero_copy_only=False)
            for row, h, *_ in _texts(batch.column(1)):
                at, g, few, most = minimisers(h, least, key)
                for o, v in zip(out, (g.view(np.int64), np.full(len(at), ids[row]), at.astype(np.int32), few.astype(np.int32), most.astype(np.int32))):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["key", "row", "at", "few", "most"])

    return run


def _contexts(key, side):
    """The words to the right of each candidate's key, and those to its left in reverse: two sortable byte strings of 4 bytes a word."""

    def run(batches):
        for batch in batches:
            rows, places = batch.column(0).to_pylist(), batch.column(2)
            for r, h, *_ in _texts(batch.column(1)):
                own = places[r].values
                at, few, most = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "few", "most"))
                small = (h >> np.uint64(32)).astype(">u4")
                raw, back, n = small.tobytes(), small[::-1].tobytes(), len(h)
                right = [raw[4 * (a + key) : 4 * (a + key + side)] for a in at.tolist()]
                left = [back[4 * (n - a) : 4 * (n - a + side)] for a in at.tolist()]
                keys = W.grams(h, key)[at].view(np.int64)
                for lo in range(0, len(at), 1 << 14):
                    hi = min(len(at), lo + (1 << 14))
                    cols = [pa.array(keys[lo:hi]), pa.array(right[lo:hi], pa.binary()), pa.array(left[lo:hi], pa.binary()), pa.array(np.full(hi - lo, rows[r])), pa.array(at[lo:hi].astype(np.int32)), pa.array(few[lo:hi].astype(np.int32)), pa.array(most[lo:hi].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "right", "left", "row", "at", "few", "most"])

    return run


def _common(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Equal leading words of each row and the one before it."""
    same = words[1:] == words[:-1]
    lcp = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
    return np.minimum(lcp, np.minimum(length[1:], length[:-1]))


def _neighbours(side):
    """Of sorted suffixes: the extents (before, after) over which each equals a neighbour of another document, and a hash of each run that they may not show in full."""

    def judged(t, last):
        """Rows of ``t`` but the first and, unless it is the end, the last."""
        m = t.num_rows
        number = {c: t.column(c).to_numpy() for c in ("key", "ctx", "some", "other", "few", "most")}
        words, size = {}, {}
        for c in ("left", "right"):
            raw = t.column(c).to_pylist()
            size[c] = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            words[c] = np.frombuffer(b"".join(x.ljust(4 * side, b"\0") for x in raw), ">u4").reshape(m, side)
        own = number["some"] == number["other"]
        met = (number["key"][1:] == number["key"][:-1]) & ~(own[1:] & own[:-1] & (number["some"][1:] == number["some"][:-1]))
        both = {c: np.where(met, _common(words[c], size[c]), -side) for c in words}
        none = np.full(m, -side)
        spans = [(np.where(own, none, size["left"]), np.where(own, none, size["right"]))]
        spans += [tuple(np.append(-side, both[c]) for c in ("left", "right")), tuple(np.append(both[c], -side) for c in ("left", "right"))]
        mine = np.ones(m, dtype=bool)
        mine[0], mine[-1] = False, last
        a = np.arange(side + 1)
        wanted = (a >= number["few"][:, None]) & (a <= number["most"][:, None]) & mine[:, None]
        covers = lambda span: (a <= span[0][:, None]) & (side - a <= span[1][:, None])
        hits = []
        for before, after in spans:
            good = np.flatnonzero(mine & (before + after >= side))
            hits.append((good, before[good], after[good]))
        # Where some run of a key is still open, each run is met by its hash; of neighbours that share it the first stands for all.
        cut = np.flatnonzero(np.concatenate(([True], number["key"][1:] != number["key"][:-1])))
        missing = np.add.reduceat((wanted & ~covers(spans[0]) & ~covers(spans[1]) & ~covers(spans[2])).any(axis=1), cut) > 0
        missing &= (np.minimum.reduceat(number["some"], cut) < np.maximum.reduceat(number["other"], cut)) | (cut == cut[-1])
        missing[[0, -1]] = True  # a key's other rows may be in the rows before or after
        open_ = wanted & ~covers(spans[1]) & np.repeat(missing, np.diff(np.append(cut, m)))[:, None]
        w, b, f = (np.concatenate(x) for x in zip(*hits))
        yield number["key"][w], number["ctx"][w], b, f, None
        w, b = np.nonzero(open_)
        seen = {}
        for c in words:
            h = [np.zeros(m, dtype=np.uint64)]
            for k in range(side):
                h.append(W.mix(h[-1] * np.uint64(3) + words[c][:, k].astype(np.uint64) + np.uint64(1)))
            seen[c] = np.stack(h, axis=1)
        run = W.mix(seen["left"][w, b] * np.uint64(5) + W.mix(seen["right"][w, side - b] + number["key"][w].view(np.uint64)))
        yield number["key"][w], number["ctx"][w], b, side - b, (run.view(np.int64), number["some"][w], number["other"][w])

    def table(key, ctx, before, after, more):
        none = [pa.nulls(len(key), pa.int64())] * 3
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), *([pa.array(x) for x in more] if more else none)], names=["key", "ctx", "before", "after", "run", "some", "other"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held is None:  # a first row of no key, so that every row has one before it
                held = t.slice(0, 1).set_column(0, "key", pa.array([~t.column("key")[0].as_py()], pa.int64()))
            t = pa.concat_tables([held, t]).combine_chunks()
            for x in judged(t, False):
                yield table(*x)
            held = t.slice(t.num_rows - 2)
        if held is not None:
            for x in judged(held.combine_chunks(), True):
                yield table(*x)

    return run


def _merged(batches):
    """Overlapping or touching spans of a text as one, in words and in code points."""
    for batch in batches:
        out = ([], [], [], [], [])
        ids, places = batch.column(0).to_pylist(), batch.column(2)
        for r, h, buf, offset, starts, ends in _texts(batch.column(1)):
            spans = []
            for a, b in sorted((s["a"], s["b"]) for s in places[r].as_py()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                lead = (buf[offset : starts[a]] & 0xC0) != 0x80
                inside = (buf[starts[a] : ends[b - 1]] & 0xC0) != 0x80
                first = int(lead.sum())
                for o, v in zip(out, (ids[r], a, b, first, first + int(inside.sum()))):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["doc_id", "first_word", "end_word", "start", "end"])


def repeated_passages(docs: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """(doc_id, first_word, end_word, start, end): passages of ``least`` words or more that another document has too.

    Words are cut at ASCII white space and compared by hashes (64 bits for a key and for
    a run, 32 for each word beside it).  Every run of ``least`` words keeps a suffix, chosen by
    the run's content; suffixes whose keys recur are sorted by what follows the key, then by what
    precedes it, and each is compared with its neighbours and extended left and right.  Runs
    around a kept suffix that no neighbour shares are met by their hashes, so that none is missed
    where different documents match on either side, or where the sort was cut into tasks.
    Spans of a text that overlap or touch are one; start and end are code points, end
    exclusive.  Texts without such a passage, short, empty and null ones have no row.  Copies
    and repeated rows count as other documents; a null doc_id keeps its rows.
    Equal contexts are merged before sorting, so a group of copies sorts as one row.
    """
    side = least - key
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    keys = keep(rows.select("row", "text").mapInArrow(W.tidy(_suffix_keys(least, key)), "key long, row long, at int, few int, most int"), "suffixes")
    # written out, as an aggregate above the exchange would keep a hot key of this join from being split
    again = keep(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "again")
    places = keys.join(again.hint("shuffle_merge"), "key").groupBy("row").agg(F.collect_set(F.struct("at", "few", "most")).alias("places"))
    found = keep(places.join(rows.select("row", "text"), "row").select("row", "text", "places").mapInArrow(W.tidy(_contexts(key, side)), "key long, right binary, left binary, row long, at int, few int, most int"), "contexts")
    drop(keys, again)
    found = found.withColumn("ctx", F.xxhash64("right", "left"))
    merged = found.groupBy("key", "ctx").agg(F.min("right").alias("right"), F.min("left").alias("left"), F.min("row").alias("some"), F.max("row").alias("other"), F.count("*").alias("c"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("few").alias("few"), F.max("most").alias("most"))
    # one row key at one place, more than once: the row itself is repeated
    twin = (F.col("c") > 1) & (F.col("lo") == F.col("hi")) & (F.col("some") == F.col("other"))
    merged = keep(merged.withColumn("other", F.when(twin, F.col("some") + 1).otherwise(F.col("other"))).drop("c", "lo", "hi"), "merged")
    order = merged.select("key", "right", "left", "ctx", "some", "other", "few", "most").repartitionByRange("key", "right", "left").sortWithinPartitions("key", "right", "left")
    marks = keep(order.mapInArrow(W.tidy(_neighbours(side)), "key long, ctx long, before int, after int, run long, some long, other long"), "marks")
    drop(merged)
    rest = marks.where("run is not null")
    shared = keep(rest.groupBy("run").agg(F.min("some").alias("least"), F.max("other").alias("most")).where("least <> most").select("run"), "runs")
    hits = marks.where("run is null").unionByName(rest.join(shared.hint("shuffle_merge"), "run").select(*marks.columns)).groupBy("key", "ctx").agg(F.collect_set(F.struct("before", "after")).alias("hits"))
    spans = found.select("key", "ctx", "row", "at").join(keep(hits, "hits").hint("shuffle_merge"), ["key", "ctx"])
    span = F.transform("hits", lambda x: F.struct((F.col("at") - x.before).alias("a"), (F.col("at") + key + x.after).alias("b")))
    spans = spans.select("row", F.explode(span).alias("span")).groupBy("row").agg(F.collect_set("span").alias("spans"))
    return rows.join(spans, "row").select("doc_id", "text", "spans").mapInArrow(W.tidy(_merged), "doc_id long, first_word long, end_word long, start long, end long")
