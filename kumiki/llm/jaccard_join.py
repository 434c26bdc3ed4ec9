"""Exact Jaccard self-join of documents over word shingles, by pivots in the metric space.

Jaccard distance is a metric, so a document's links lie in a ball of radius 1/4 around it.

1. Equal sets are one class, so copies never meet.
2. A linked set has three quarters of its shingles in another set.  Shingles are
   counted in ranges of their hash values; classes with fewer recurring shingles link with nothing
   and go no further.
3. Of the others, every shingle heads a region of the sets that hold it early: with
   shingles in order of their counts, among the first ``n - ceil(3n/4) + 1``.  Of two linked
   sets each holds a shingle early that the other holds early too.
4. A member of each region is its pivot, and each set is measured against the pivots of
   its regions.  The ball of a pivot p has the sets within 1/4 of it.  By the triangle
   inequality a link from the ball ends within 1/2 of p: only those boundary sets are
   replicated into the cell of p, in which every link that has an end in the ball is found.
   What is outside the ball stays in the region, which is cut again by another pivot, until
   it is small or its balls take out no more; the rest of a region is one more cell.
5. Sets within 1/8 of the same pivot are linked with each other by the triangle inequality:
   they are counted, not compared.  Large cells are cut into blocks that meet two by two.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .tables import drop, drop_since, free, keep, kept, text_rows

#: Shingles and documents that a task counts before it sends them, and shingles that a range of hash values holds on average.
CHUNK, CHUNK_ROWS, RANGE = 1 << 20, 60_000, 1 << 21
#: Regions of more members are cut by pivots again, at most so many times and while the region's last ball took a twentieth out.
CROWDED, ROUNDS = 4096, 12
#: Members and shingles of a block, on average; a cell holds one or two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20
#: Ids that a broadcast may hold (8 bytes each); more are met by a shuffle.
MOST_IDS = 1 << 21
_NOBODY = 0xFFFF
#: Last cells of a round have its number and this one more; rounds are fewer.
_LAST = 16


def _sets(column: pa.Array, n: int):
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi, buf, offs in W.blocks(column):
        starts, ends, first = W.split(buf, offs)
        h = W.hashes(buf, starts, ends)
        for i in range(hi - lo):
            yield lo + i, W.shingle_set(h[first[i] : first[i + 1]], n)


def _digest(s: np.ndarray) -> tuple[int, int, int]:
    """Two 64-bit sums that with the size name a set."""
    one, two = s.sum(dtype=np.uint64), W.mix(s + np.uint64(len(s))).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64)), len(s)


_CHUNK_SCHEMA = "part int, chunk long, keys binary, slots binary, ids array<long>, f1 array<long>, f2 array<long>, n array<long>, head array<long>, recur array<long>"


def _chunks(n: int, ranges: int):
    """A task's documents in chunks: one row (part -1) of their digests, and for each range of hash values the chunk's shingles, once each.

    ``slots`` names the document of a shingle that no other of the chunk has; one that
    recurs within the chunk is counted here, in ``recur``.  They ascend and are sent as differences.  Of equal sets in a
    chunk the first, their ``head``, sends the shingles.
    """
    names = [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]

    def flush(ids, digests, heads, sets):
        chunk = int.from_bytes(os.urandom(8), "little") >> 1
        owner = np.repeat(np.array([k for k, _ in sets], dtype=np.uint16), [len(s) for _, s in sets])
        h = np.concatenate([s for _, s in sets]) if sets else np.zeros(0, np.uint64)
        sets.clear()
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        edge = np.ones(len(h) + 1, dtype=bool)
        edge[1:-1] = h[1:] != h[:-1]
        alone = edge[:-1] & edge[1:]
        recur = np.bincount(owner[~alone], minlength=len(ids))
        first = np.flatnonzero(edge[:-1])
        keys, slots = h[first], np.where(alone[first], owner[first], _NOBODY).astype(np.int64)
        del h, owner, order, edge, alone, first
        part = (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(ranges + 1))
        order = np.argsort(part << 16 | slots, kind="stable")
        low, slots = keys.astype(np.uint32)[order], np.diff(slots[order], prepend=0)
        del keys, part, order
        use = np.flatnonzero(np.diff(cut)).tolist()
        slots[cut[use]] += np.append(0, np.cumsum(slots))[cut[use]]  # a part's first one is whole
        slots = slots.astype(np.uint16)
        f1, f2, size = (list(c) for c in zip(*digests))
        none = [None] * len(use)
        rows = [[-1, *use], [chunk] * (len(use) + 1), [None, *(low[cut[i] : cut[i + 1]].tobytes() for i in use)], [None, *(slots[cut[i] : cut[i + 1]].tobytes() for i in use)]]
        rows += [[c, *none] for c in (ids, f1, f2, size, heads, recur.tolist())]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 6]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)

    def run(batches):
        def fresh():
            return [], [], [], [], {}

        (ids, digests, heads, sets, seen), held = fresh(), 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, s in _sets(batch.column(1), n):
                digest, slot = _digest(s), len(ids)
                head = seen.setdefault(digest, slot)
                ids.append(own[row])
                digests.append(digest)
                heads.append(head)
                if head == slot and len(s):
                    sets.append((slot, s))
                    held += len(s)
                if held >= CHUNK or len(ids) >= CHUNK_ROWS:
                    yield flush(ids, digests, heads, sets)
                    (ids, digests, heads, sets, seen), held = fresh(), 0
        if ids:
            yield flush(ids, digests, heads, sets)

    return run


def _runs(batches, keys: int):
    """Lists of the rows (as one batch each) that share the first ``keys`` columns, of batches sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cut = np.concatenate(([0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            mark = tuple(marks[:, a].tolist())
            if mark != last and held:
                yield held
                held = []
            last = mark
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _recurring(batches):
    """(chunk, slots): in each range, the documents of the shingles that more than one chunk sent."""
    for held in _runs(batches, 1):
        chunks = [c for b in held for c in b.column(1).to_pylist()]
        low = [np.frombuffer(k, np.uint32) for b in held for k in b.column(2).to_pylist()]
        slots = [np.cumsum(np.frombuffer(k, np.uint16), dtype=np.uint16) for b in held for k in b.column(3).to_pylist()]
        size = [len(k) for k in low]
        keys = np.concatenate(low)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        out, at = ([], []), 0
        for chunk, k, s in zip(chunks, size, slots):
            mine = s[again[at : at + k]]
            mine = mine[mine != _NOBODY]
            at += k
            if len(mine):
                out[0].append(chunk)
                out[1].append(mine.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["chunk", "slots"])


def _judged(batches):
    """(doc_id, n, f1, f2, maybe) of each document of a chunk; maybe: enough of its shingles recur for a link."""
    for held in _runs(batches, 1):
        told, more = None, []
        for b in held:
            for r in range(b.num_rows):
                if b.column(2)[r].is_valid:
                    told = [b.column(c)[r].values for c in range(2, 8)]
                else:
                    more.append(np.frombuffer(b.column(1)[r].as_py(), np.uint16))
        ids, f1, f2, n, head, recur = told
        count = recur.to_numpy(zero_copy_only=False) + np.bincount(np.concatenate(more), minlength=len(ids)) if more else recur.to_numpy(zero_copy_only=False)
        size = n.to_numpy(zero_copy_only=False)
        maybe = (size > 0) & (4 * count[head.to_numpy(zero_copy_only=False)] >= 3 * size)
        for lo in range(0, len(ids), 1 << 14):
            yield pa.RecordBatch.from_arrays([c.slice(lo, 1 << 14) for c in (ids, n, f1, f2)] + [pa.array(maybe[lo : lo + (1 << 14)])], names=["doc_id", "n", "f1", "f2", "maybe"])


def digested(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, f1, f2, maybe, rid) of every row of ``docs(doc_id, text)``, written out."""
    ranges = max(1, int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6 / RANGE) + 1)
    chunks = keep(docs.mapInArrow(W.tidy(_chunks(n, ranges)), _CHUNK_SCHEMA), "chunks")
    dealt = chunks.where("part >= 0").select("part", "chunk", "keys", "slots").repartition("part").sortWithinPartitions("part")
    again = dealt.mapInArrow(W.tidy(_recurring), "chunk long, slots binary")
    told = chunks.where("part < 0").select("chunk", F.lit(None).cast("binary").alias("slots"), "ids", "f1", "f2", "n", "head", "recur")
    more = again.select("chunk", "slots", *[F.lit(None).cast("array<long>").alias(c) for c in ("ids", "f1", "f2", "n", "head", "recur")])
    rows = told.unionAll(more).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(W.tidy(_judged), "doc_id long, n long, f1 long, f2 long, maybe boolean")
    out = keep(rows.withColumn("rid", F.monotonically_increasing_id()), "digests")
    drop(chunks)
    return out


def _full_sets(n: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [s for _, s in _sets(batch.column(0).slice(lo, 256), n)]
                f1, f2, size = zip(*map(_digest, sets))
                ends = np.array([0, *size]).cumsum().astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["f1", "f2", "n", "shingles"])

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(cid, n, copies, shingles) of the ``classes``, written out: the texts of their ids are hashed again."""
    key = F.coalesce("doc_id", F.lit(-1))
    ids = classes.select(key.alias("k")).distinct()
    ids = F.broadcast(ids) if classes.count() <= MOST_IDS else ids
    held = docs.withColumn("k", key).join(ids, "k", "left_semi").select("text").mapInArrow(W.tidy(_full_sets(n)), "f1 long, f2 long, n long, shingles array<long>")
    named = held.join(classes.select("cid", "f1", "f2", "n", "copies"), ["f1", "f2", "n"])
    return keep(named.dropDuplicates(["f1", "f2", "n"]).select("cid", "n", "copies", "shingles"), "sets")


def linked(inter: Column, a: Column, b: Column) -> Column:
    """100 * intersection >= 75 * union, in whole numbers."""
    return 100 * inter >= 75 * (a + b - inter)


def _early(sets: DataFrame) -> DataFrame:
    """(s, cid, n): the shingles that each set holds early and that another set has too, written out."""
    held = sets.select("cid", "n", F.explode("shingles").alias("s"))
    counts = keep(held.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    own = Window.partitionBy("cid")
    placed = held.join(counts, "s").withColumn("c", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("df", "s")))
    # shingles of no other set come first in the order: c of the set's n are left for the places after them
    out = keep(placed.where("n - c + r <= n - floor((3 * n + 3) / 4) + 1").select("s", "cid", "n"), "members")
    drop(counts)
    return out


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, p, kind) of the pairs within distance 1/2: kind 2 within 1/8, 1 within 1/4 (a link), 0 beyond; written out."""
    near, pivot = sets.select("cid", "n", "shingles"), sets.select(F.col("cid").alias("p"), F.col("n").alias("np"), F.col("shingles").alias("sp"))
    met = pairs.join(near, "cid").join(pivot, "p").select("cid", "p", "n", "np", F.size(F.array_intersect("shingles", "sp")).cast("long").alias("i"))
    kind = F.when(8 * F.col("i") >= 7 * (F.col("n") + F.col("np") - F.col("i")), 2).when(linked(F.col("i"), F.col("n"), F.col("np")), 1).otherwise(0)
    return keep(met.where("2 * i >= n + np - i").select("cid", "p", kind.alias("kind")), "measured")


def _marks(members: DataFrame, sets: DataFrame, crowded: int, rounds: int) -> DataFrame:
    """(g, p, cid, kind): the cells of each set; g names the cell, kind 0 is its boundary.  Written out.

    Two linked sets share a cell that has one of them in its ball, or a last cell.  Each region
    decides for itself: all are cut once, and again while they are large and the last cut took enough out.
    """
    out, members = None, members.withColumn("before", F.lit(None).cast("long"))
    for turn in range(rounds + 1):
        first = F.min(F.struct(F.xxhash64("cid").alias("rank"), F.col("cid").alias("p"), F.col("n").alias("np"))).alias("first")
        closed = F.lit(turn == rounds) | F.coalesce((F.col("m") <= crowded) | (F.col("m") > 0.95 * F.col("before")), F.lit(False)) if turn else F.lit(rounds == 0)
        heads = members.groupBy("s").agg(first, F.count("*").alias("m"), F.first("before").alias("before")).where("m > 1")
        heads = keep(heads.select("s", "first.p", "first.np", "m", closed.alias("closed")), "heads", narrow=True)
        held = {r.closed for r in heads.select("closed").distinct().collect()}  # two rows at most
        placed = lambda ended, heads=heads, members=members: members.join(heads.where("closed" if ended else "not closed"), "s").where("cid <> p")
        cells = []
        if True in held:
            found = keep(placed(True).select("cid", "p").distinct(), "last", narrow=True)
            cells.append((_LAST + turn, 1, found.withColumn("kind", F.lit(1))))
        if False in held:
            pairs = placed(False).groupBy("cid", "p").agg(F.first("n").alias("n"), F.first("np").alias("np"))
            measured = _measured(pairs.where("2 * least(n, np) >= greatest(n, np)").select("cid", "p"), sets)
            # a pivot without a set in its ball besides itself has no links in its cell
            cells.append((turn, 2, measured.join(measured.where("kind > 0").select("p").distinct(), "p", "left_semi")))
        for number, own, found in cells:
            all_ = found.unionByName(found.select("p").distinct().select(F.col("p").alias("cid"), "p", F.lit(own).alias("kind")))
            cell = all_.select((F.shiftleft("p", 5) + number).alias("g"), "p", "cid", "kind")
            out = cell if out is None else out.unionAll(cell)
        if False not in held:
            break
        left = placed(False).join(measured.where("kind > 0").select("cid", "p"), ["cid", "p"], "left_anti")
        members = keep(left.select("s", "cid", "n", F.col("m").alias("before")), "members", narrow=True)
    return None if out is None else keep(out, "marks", narrow=True)


def _cells(marks: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, root, others) from every cell: a set's root among the cell's links, and the rows that its links counted here lead to."""
    own = marks.groupBy("cid").agg(F.collect_list(F.struct("g", "kind")).alias("own"))
    own = own.withColumn("home", F.array_min(F.transform(F.filter("own", lambda m: m.kind == 2), lambda m: m.g)))
    rows = marks.join(own, "cid").join(sets.select("cid", "n", "copies"), "cid").withColumn("class", F.when(F.col("home") == F.col("g"), 1).when(F.col("kind") > 0, 0).otherwise(2))
    rows = keep(rows, "placed")
    blocks = lambda members, shingles: F.ceil(F.greatest(members / BLOCK_MEMBERS, shingles / BLOCK_SHINGLES))
    of = lambda c: blocks(F.count_if(F.col("class") == c), F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)))
    sized = rows.groupBy("g").agg(of(0).alias("k0"), of(1).alias("k1"), of(2).alias("k2"), blocks(F.count("*"), F.sum("n")).alias("k"))
    # blocks are numbered class by class; a cell that fits one block is one
    placed = rows.join(sized, "g").withColumn("k0", F.when(F.col("k") <= 1, 1).otherwise(F.col("k0"))).withColumn("k1", F.when(F.col("k") <= 1, 0).otherwise(F.col("k1"))).withColumn("k2", F.when(F.col("k") <= 1, 0).otherwise(F.col("k2")))
    start, many = F.expr("CASE class WHEN 0 THEN 0 WHEN 1 THEN k0 ELSE k0 + k1 END"), F.expr("CASE class WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END")
    placed = placed.withColumn("i", F.when(F.col("k") <= 1, 0).otherwise(start + F.pmod(F.xxhash64("cid"), F.greatest(many, F.lit(1)))).cast("long"))
    # inner blocks meet all, those of the close sets also the boundary
    meets = F.expr("filter(sequence(0L, k0 + k1 + k2 - 1), j -> least(i, j) < k0 OR (least(i, j) < k0 + k1 AND greatest(i, j) >= k0 + k1))")
    met = placed.withColumn("j", F.explode(meets)).select("g", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "i", "cid", "kind", "home", "own")
    met = met.join(sets.select("cid", "n", "copies", "shingles"), "cid")
    dealt = met.select("g", "a", "b", "i", "cid", "n", "copies", "kind", "home", "own", "shingles").repartition("g", "a", "b").sortWithinPartitions("g", "a", "b")
    return keep(dealt.mapInArrow(W.tidy(_cell_rows), "cid long, root long, others long"), "cells")


def _cell_rows(batches):
    for held in _runs(batches, 3):
        yield _cell_links(pa.Table.from_batches(held).combine_chunks())


def _overlaps(sets: pa.ListArray) -> np.ndarray:
    """Sizes of the intersections of all sets of a cell, by products of indicator matrices."""
    m = len(sets)
    owner = np.repeat(np.arange(m), pc.list_value_length(sets).to_numpy(zero_copy_only=False))
    _, at, many = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    shared = many[at] > 1
    owner, at = owner[shared], (np.cumsum(many > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    inter, width = np.zeros((m, m)), 8192
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [lo, lo + width])
        wide = min(width, int(at[-1]) + 1 - lo)
        has = np.zeros((m, wide), dtype=np.float32)
        has[owner[a:b], at[a:b] - lo] = 1
        inter += has @ has.T
    return inter


def _cell_links(rows: pa.Table) -> pa.RecordBatch:
    number = lambda c: rows.column(c).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    g, block, cid, n, copies, kind, home = (number(c) for c in ("g", "i", "cid", "n", "copies", "kind", "home"))
    inter, m = _overlaps(rows.column("shingles").combine_chunks()), len(cid)
    good = (100 * inter >= 75 * (n[:, None] + n[None] - inter)) & ((kind > 0)[:, None] | (kind > 0)[None])
    good[np.arange(m), np.arange(m)] = False
    if (block != block[0]).any():
        good &= block[:, None] != block[None]
    root = np.arange(m)
    while True:
        least = np.minimum(root, np.where(good, root[None], m).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    # a link is counted in the first of the cells that hold it; sets at home in one cell are counted by its size
    count = good & ((home < 0)[:, None] | (home[:, None] != home[None]))
    own = rows.column("own").combine_chunks()
    who = np.repeat(np.arange(m), pc.list_value_length(own).to_numpy(zero_copy_only=False))
    flat = own.flatten()
    cell, inside = flat.field("g").to_numpy(zero_copy_only=False), flat.field("kind").to_numpy(zero_copy_only=False) > 0
    before = cell < g[0]
    if before.any():
        names, at = np.unique(cell[before], return_inverse=True)
        has, ball = np.zeros((m, len(names)), dtype=np.float32), np.zeros((m, len(names)), dtype=np.float32)
        has[who[before], at] = 1
        ball[who[before], at] = inside[before]
        met = ball @ has.T
        count &= (met + met.T) == 0
    others = count @ copies
    use = np.flatnonzero((others > 0) | (root != np.arange(m)))
    return pa.RecordBatch.from_arrays([pa.array(cid[use]), pa.array(cid[root[use]]), pa.array(others[use])], names=["cid", "root", "others"])


def _joined(docs: DataFrame, classes: DataFrame, n: int, crowded: int, rounds: int) -> tuple[DataFrame, DataFrame] | None:
    """Links (a, b) whose components are those of all links, and (cid, others): the rows that each class links to besides its own."""
    sets = _sets_of(docs, classes.where("maybe"), n)
    members = _early(sets)
    marks = _marks(members, sets, crowded, rounds)
    if marks is None:
        return None
    cells = _cells(marks, sets)
    balls = marks.where(F.col("kind") > 0).where(F.col("cid") != F.col("p")).where(F.col("g") % (2 * _LAST) < _LAST)
    links = balls.select(F.col("cid").alias("a"), F.col("p").alias("b")).unionAll(cells.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    homes = marks.where("kind = 2").groupBy("cid").agg(F.min("g").alias("home")).join(sets.select("cid", "copies"), "cid")
    homes = keep(homes, "homes", narrow=True)
    total = homes.groupBy("home").agg(F.sum("copies").alias("total"))
    close = homes.join(total, "home").select("cid", (F.col("total") - F.col("copies")).alias("others"))
    others = cells.select("cid", "others").unionAll(close).groupBy("cid").agg(F.sum("others").alias("others"))
    return links, others


def jaccard_components(docs: DataFrame, n: int = 5, crowded: int = CROWDED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size, n_links of every row of ``docs(doc_id, text)``.

    Texts are lower-cased in A-Z and cut at ASCII white space; a set holds the
    distinct ``n``-word shingles, or the whole sequence when it has fewer words.
    Two documents link when ``100 * intersection >= 75 * union``; component_id
    is the smallest doc_id that links reach, n_links the number of other rows that the
    row links to, copies included.  Null and empty texts, and texts
    without words, have the empty set, size 0, and are linked with nothing: their
    component is their own doc_id.  Rows repeat as they are given; equal sets
    share a component, class_size counts their rows.  A null doc_id names a
    component only when no member has another.  An empty table gives no row.
    Sets are compared by 64-bit hashes of their shingles, classes by 128 bits.
    Documents that repeat a doc_id with different texts are separate members.
    """
    base, mark = text_rows(docs), kept()
    rows = digested(base, n)
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("rid").alias("cid"), F.min_by("doc_id", "rid").alias("doc_id"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("maybe").alias("maybe"))
    classes = keep(classes, "classes", narrow=True)
    joined = _joined(base, classes, n, crowded, min(rounds, _LAST - 1))
    named = classes.select("cid", "f1", "f2", "n", "least", "copies")
    if joined is None:
        named = named.withColumn("component_id", F.col("least")).withColumn("others", F.lit(0))
    else:
        links, others = joined
        roots = components(links)
        named = named.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").join(others, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        named = keep(named, "named", narrow=True)
        names = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(names, "root")
    # classes of one row without a link say nothing that the row does not
    told = keep(named.where("copies > 1 OR others > 0").select("f1", "f2", "n", "component_id", "copies", "others"), "told", narrow=True)
    drop_since(docs.sparkSession, mark, rows, told)
    out = rows.select("doc_id", "n", "f1", "f2").join(told, ["f1", "f2", "n"], "left")
    copies = F.coalesce("copies", F.lit(1)).cast("long")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), copies.alias("class_size"), (copies - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5) -> DataFrame:
    """The rows of ``docs`` without all but one of each group that links join.

    Rows are numbered once and decided one by one, whatever their doc_id: of a group the
    row of the smallest doc_id stays, null ids last, of such rows the first.
    Documents without words stay.  All columns of ``docs`` are returned.
    """
    (row,) = free(docs, "_row")
    rows, mark = keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), kept()
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), n).where("n_links > 0")
    groups = keep(groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups", narrow=True)
    members = groups.join(rows.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("_id")), "_row")
    first = members.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"))
    gone = keep(groups.join(first.select("_group", F.col("first._row").alias("_first")), "_group").where("_row <> _first").select(F.col("_row").alias(row)), "gone", narrow=True)
    drop_since(docs.sparkSession, mark, gone)
    return rows.join(gone, row, "left_anti").select(*docs.columns)
