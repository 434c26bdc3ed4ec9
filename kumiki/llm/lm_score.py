"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import drop, keep, text_rows

#: Words fall in so many cells, by the leading bits of their hash; cells are counted over all documents.
CELL_BITS = 24
#: Cells are counted in ranges of this many bits.
_LOW = CELL_BITS - 8
_COUNTS = "part int, cells binary, counts binary"
#: Commonest cells, each an output of its own, in classes of equal size; words on each side; width of the network.
VOCABULARY, CLASS, SIDE, WIDTH = 1024, 32, 2, 24
#: Rounds of training; each masks its own share of the positions, so that all rounds together mask every position once.
ROUNDS = 2
#: Words of a training step, and of a scoring one (what a core's cache holds).
_BATCH, _SCORED = 8192, 8192
#: Words whose classes are worked out at once; runs of so many rows or fewer are added side by side; sums beyond which exp takes the largest off first.
PIECE, SHORT, LARGE = 1024, 4, 60.0
#: Bytes of the texts of a shard, on average: what one network is trained on in a round.  Shards that one task trains and adds up, at most.
SHARD_BYTES, GROUP = 1 << 24, 4


class WindowNet:
    """h = tanh(sum of one embedding for each place of the window); P(output) = P(class | h) P(output | class, h)."""

    def __init__(self, seed: int = 3, outputs: int = VOCABULARY):
        r = np.random.RandomState(seed)
        v, d, c = outputs + 1, WIDTH, outputs // CLASS  # the last id lies outside the text
        self.p = [(r.randn(2 * SIDE, v, d) * 0.1).astype(np.float32), np.zeros(d, np.float32), np.zeros((d, c), np.float32), np.zeros(c, np.float32), np.zeros((c, d, CLASS), np.float32), np.zeros((c, CLASS), np.float32)]
        self.g = [np.full(x.shape, 1e-3, np.float32) for x in self.p]

    def pack(self) -> bytes:
        return np.concatenate([x.reshape(-1) for x in self.p]).astype(np.float32).tobytes()

    def load(self, flat: np.ndarray) -> "WindowNet":
        at = 0
        for k, x in enumerate(self.p):
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """One column for each context; the last row is of ones, for the biases."""
        h = self.p[0][0].take(context[:, 0], axis=0)
        for j in range(1, 2 * SIDE):
            h += self.p[0][j].take(context[:, j], axis=0)
        h += self.p[1]
        out = np.empty((WIDTH + 1, len(h)), dtype=np.float32)
        out[-1] = 1
        np.tanh(h.T, out=out[:-1])
        return out

    def _weights(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Rows of classes, and of the outputs of each class, with their biases; whether their products with what is hidden (1 at most) may be too large for exp."""
        rows = np.concatenate((self.p[2].T, self.p[3][:, None]), axis=1), np.concatenate((self.p[4].transpose(0, 2, 1), self.p[5][:, :, None]), axis=2)
        return *rows, max(float(np.abs(x).sum(axis=-1).max()) for x in rows) > LARGE

    def _slices(self, cls: np.ndarray):
        """Targets in order of their classes, and (class, first, last) of each class that has some."""
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # outputs stay below 2**16, in which stable sorts are linear
        cut = np.searchsorted(cls[order], np.arange(len(self.p[3]) + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        cls, within = target // CLASS, target % CLASS
        order, slices = self._slices(cls)
        h, cls, within, column = self.hidden(context.take(order, axis=0)), cls[order], within[order], np.arange(len(target))
        top, inner, large = self._weights()
        mine, sums = np.empty((2, len(target)), dtype=np.float32)
        for a in range(0, len(target), PIECE):  # what a core's nearest cache holds
            b = min(len(target), a + PIECE)
            z = top @ h[:, a:b]
            if large:
                z -= z.max(axis=0)
            mine[a:b] = z[cls[a:b], column[: b - a]]
            np.exp(z, out=z).sum(axis=0, out=sums[a:b])
        mine -= np.log(sums)
        for c, a, b in slices:
            y = inner[c] @ h[:, a:b]
            if large:
                y -= y.max(axis=0)
            mine[a:b] += y[within[a:b], column[: b - a]]
            np.add.reduce(np.exp(y, out=y), axis=0, out=sums[a:b])
        mine -= np.log(sums)
        out = np.empty(len(target), dtype=np.float32)
        out[order] = mine
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float = 0.1) -> None:
        """One AdaGrad step on the mean negative log-probability."""
        n, cls, within = len(target), target // CLASS, target % CLASS
        order, slices = self._slices(cls)
        context, cls, within, column = context.take(order, axis=0), cls[order], within[order], np.arange(n)
        h = self.hidden(context)
        top, inner, large = self._weights()
        back, outer = np.empty((WIDTH, n), dtype=np.float32), np.zeros((WIDTH + 1, len(top)), dtype=np.float32)
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            z = top @ h[:, a:b]
            if large:
                z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            z[cls[a:b], column[: b - a]] -= 1
            np.matmul(self.p[2], z, out=back[:, a:b])
            outer += h[:, a:b] @ z.T
        own = np.zeros((len(inner), WIDTH + 1, CLASS), dtype=np.float32)
        for c, a, b in slices:
            part = h[:, a:b]
            y = inner[c] @ part
            if large:
                y -= y.max(axis=0)
            np.exp(y, out=y)
            y /= np.add.reduce(y, axis=0)
            y[within[a:b], column[: b - a]] -= 1
            np.matmul(part, y.T, out=own[c])
            back[:, a:b] += self.p[4][c] @ y
        back *= 1 - h[:-1] * h[:-1]
        back = np.ascontiguousarray(back.T)
        for k, g in [(2, outer[:-1]), (3, outer[-1]), (4, own[:, :-1]), (5, own[:, -1]), (1, back.sum(axis=0))]:
            g = g / n
            self.g[k] += g * g
            self.p[k] -= rate * g / np.sqrt(self.g[k])
        # of the embeddings only those that the batch has move
        rows = (context + np.arange(2 * SIDE) * self.p[0].shape[1]).reshape(-1)
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        g = _sums(back, order // (2 * SIDE), first) / n
        table, seen = (x.reshape(-1, WIDTH) for x in (self.p[0], self.g[0]))
        own = seen[rows[first]] + g * g
        seen[rows[first]] = own
        table[rows[first]] -= rate * g / np.sqrt(own)


def _sums(values: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows at ``places`` from each of ``first`` to the next; short runs, of which there are many, are added side by side."""
    size, out = np.diff(np.append(first, len(places))), np.empty((len(first), values.shape[1]), dtype=values.dtype)
    for k in range(1, SHORT + 1):
        own = np.flatnonzero(size == k)
        total = values.take(places[first[own]], axis=0)
        for j in range(1, k):
            total += values.take(places[first[own] + j], axis=0)
        out[own] = total
    own = np.flatnonzero(size > SHORT)
    if len(own):
        long = values.take(places[np.repeat(size > SHORT, size)], axis=0)
        out[own] = np.add.reduceat(long, np.cumsum(size[own]) - size[own], axis=0)
    return out


class Vocabulary:
    """Cells of words by hash.  The commonest cells are outputs of their own, the others share hashed outputs, whose number grows with the root of theirs.

    A cell of a hashed output has its share of the output's count as its probability
    there, so that the probabilities of all cells sum to one.
    """

    def __init__(self, counts: np.ndarray):
        use = np.flatnonzero(counts)
        own = counts[use].astype(np.int64)
        top = _commonest(use, own)[0]
        self._hold(len(use), top, _shared(use, own, top, _hashed(len(use))))

    @classmethod
    def of(cls, table: DataFrame) -> "Vocabulary":
        """That of the counts that ``counted`` gives: tasks choose the commonest of their ranges and add up the outputs' counts; no count of another cell comes to the driver."""

        def commonest(batches):
            used, cells, counts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            for own, c in _ranges(batches):
                used += len(own)
                cells, counts = _commonest(np.concatenate((cells, own)), np.concatenate((counts, c)))
            if used:
                yield pa.RecordBatch.from_arrays([pa.array([used], pa.int64()), pa.array([cells.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["used", "cells", "counts"])

        some = table.mapInArrow(W.tidy(commonest), "used long, cells binary, counts binary").collect()
        top = _commonest(*(np.frombuffer(b"".join(r[k] for r in some), np.int64) for k in (1, 2)))[0]
        used = sum(r.used for r in some)
        many = _hashed(used)

        def shared(batches):
            total = np.zeros(many, dtype=np.int64)
            for own, c in _ranges(batches):
                total += _shared(own, c, top, many)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        out = cls.__new__(cls)
        out._hold(used, top, sum((np.frombuffer(r.total, np.int64) for r in table.mapInArrow(W.tidy(shared), "total binary").collect()), np.zeros(many, dtype=np.int64)))
        return out

    def _hold(self, used: int, top: np.ndarray, totals: np.ndarray) -> None:
        order = np.argsort(top)
        self.used, self.known, self.rank, self.totals, self.outputs = used, top[order], order, totals, VOCABULARY + len(totals)

    def ids(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The output of each cell, and whether it is a hashed one."""
        hashed = VOCABULARY + cells % len(self.totals)
        if not len(self.known):
            return hashed, np.ones(len(cells), dtype=bool)
        at = np.minimum(np.searchsorted(self.known, cells), len(self.known) - 1)
        other = self.known[at] != cells
        return np.where(other, hashed, self.rank[at]), other


def _commonest(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The VOCABULARY commonest cells, the smaller first where counts are equal, and their counts."""
    order = np.lexsort((cells, -counts))[:VOCABULARY]
    return cells[order], counts[order]


def _hashed(used: int) -> int:
    """How many hashed outputs so many cells share."""
    return CLASS * max(1, math.ceil(math.sqrt(used) / CLASS))


def _shared(cells: np.ndarray, counts: np.ndarray, top: np.ndarray, many: int) -> np.ndarray:
    """The count of each of ``many`` hashed outputs, to which cells outside ``top`` belong."""
    return np.bincount(cells % many, np.where(np.isin(cells, top), 0, counts), many).astype(np.int64)


def _ranges(batches):
    """Cells and their counts, of each row of _COUNTS."""
    for batch in batches:
        for part, cells, counts in zip(*(col.to_pylist() for col in batch.columns)):
            yield (part << _LOW) + np.frombuffer(cells, np.uint16).astype(np.int64), np.frombuffer(counts, np.int64)


def cell_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _outputs(column, words: Vocabulary):
    """For blocks of texts: outputs of their words, each text's first position, cells and whether the output is a hashed one."""
    for lo, hi, buf, offs in W.blocks(column, 1 << 19):
        starts, ends, first = W.split(buf, offs)
        cells = cell_of(W.hashes(buf, starts, ends))
        ids, other = words.ids(cells)
        yield lo, hi, ids, first, cells, other


def _contexts(ids: np.ndarray, first: np.ndarray, places: np.ndarray, outside: int) -> np.ndarray:
    """The outputs around the words at ``places``; ``outside`` where their text, which begins at one of ``first``, has none."""
    n, size = len(ids), np.diff(first)
    padded = np.full(n + 2 * SIDE, outside, dtype=np.int64)
    padded[SIDE : SIDE + n] = ids
    before = (np.arange(n) - np.repeat(first[:-1], size))[places]
    after = np.repeat(size, size)[places] - 1 - before
    context = np.empty((len(places), 2 * SIDE), dtype=np.int64)
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        context[:, j] = np.where(before >= -d if d < 0 else after >= d, padded[SIDE + d + places], outside)
    return context


def counted(rows: DataFrame) -> DataFrame:
    """How often the words of each cell stand in all documents, a row of _COUNTS for each range of cells: tasks count, ranges are added up."""

    def cut(counts, base=0):
        for part in range(len(counts) >> _LOW):
            own = counts[part << _LOW : (part + 1) << _LOW]
            use = np.flatnonzero(own)
            if len(use):
                yield pa.RecordBatch.from_arrays([pa.array([base + part], pa.int32()), pa.array([use.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[use].tobytes()], pa.binary())], names=["part", "cells", "counts"])

    def count(batches):
        counts, held, size = np.zeros(1 << CELL_BITS, dtype=np.int64), [], 0

        def add():
            cells, c = np.unique(np.concatenate(held), return_counts=True)
            counts[cells] += c

        for batch in batches:
            for _, _, buf, offs in W.blocks(batch.column(0)):
                starts, ends, _ = W.split(buf, offs)
                held.append(cell_of(W.hashes(buf, starts, ends)))
                size += len(held[-1])
                if size > 1 << 21:
                    add()
                    held, size = [], 0
        if held:
            add()
        yield from cut(counts)

    def total(batches):
        at, counts = None, None
        for batch in batches:
            for part, cells, c in zip(*(col.to_pylist() for col in batch.columns)):
                if part != at:
                    if at is not None:
                        yield from cut(counts, at)
                    at, counts = part, np.zeros(1 << _LOW, dtype=np.int64)
                counts[np.frombuffer(cells, np.uint16)] += np.frombuffer(c, np.int64)
        if at is not None:
            yield from cut(counts, at)

    dealt = rows.select("text").mapInArrow(W.tidy(count), _COUNTS).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(W.tidy(total), _COUNTS)


def cell_counts(rows: DataFrame) -> np.ndarray:
    """How often the words of each cell stand in all documents, 8 bytes for each of 2**CELL_BITS cells."""
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for r in counted(rows).collect():  # at most 10 bytes for each cell
        out[(r.part << _LOW) + np.frombuffer(r.cells, np.uint16).astype(np.int64)] = np.frombuffer(r.counts, np.int64)
    return out


class CellCounts:
    """Counts of cells for scoring, four bytes each; counts beyond them stay at the largest.

    Holds what has a count, or all cells where that is less: at most 4 bytes for each of
    2**CELL_BITS cells, and little where there are few words.
    """

    def __init__(self, table: DataFrame, used: int):
        self.cells, self.all = None, None
        if 2 * used > 1 << CELL_BITS:
            self.all = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        else:
            self.cells, self.counts = np.empty((2, used), dtype=np.uint32)

        def narrow(batches):
            for cells, counts in _ranges(batches):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint32).tobytes()], pa.binary()) for x in (cells, np.minimum(counts, 0xFFFFFFFF))], names=["cells", "counts"])

        at = 0
        for r in table.mapInArrow(W.tidy(narrow), "cells binary, counts binary").toLocalIterator():  # some ranges at a time
            cells, counts = np.frombuffer(r.cells, np.uint32), np.frombuffer(r.counts, np.uint32)
            if self.cells is None:
                self.all[cells] = counts
            else:
                self.cells[at : at + len(cells)], self.counts[at : at + len(cells)] = cells, counts
                at += len(cells)

    def of_all(self) -> np.ndarray:
        """The count of every cell; a worker sets them out once."""
        if self.all is None:
            self.all = np.zeros(1 << CELL_BITS, dtype=np.uint32)
            self.all[self.cells] = self.counts
            self.cells = self.counts = None
        return self.all


def masked_in(turn: int, places: np.ndarray, rounds: int) -> np.ndarray:
    """The words, by their places in their texts, that round ``turn`` masks: the rounds' shares are disjoint and cover every text."""
    return places % rounds == turn


def coded(rows: DataFrame, words) -> DataFrame:
    """``rows`` with ids for text, two bytes for the output of each word (outputs stay below 2**16); ``words`` is a broadcast Vocabulary."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for lo, hi, ids, first, *_ in _outputs(batch.column(len(others)), words.value):
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(others))), raw], names=[*others, "ids"])

    kinds = dict(rows.dtypes)
    return rows.select(*others, "text").mapInArrow(W.tidy(run), ", ".join([*(f"{c} {kinds[c]}" for c in others), "ids binary"]))


def sharded(rows: DataFrame, words=None) -> DataFrame:
    """(shard, text) of all rows, written out in an order that ids and texts alone decide; a shard holds some SHARD_BYTES of texts.

    A partition holds up to GROUP whole shards; how many changes the plan, not what a shard holds.  With ``words``, a
    broadcast Vocabulary, texts are ``coded``: a third of the bytes, and words are cut and hashed once for all rounds.
    """
    shards = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES))
    keyed = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("doc_id", "text", F.lit(1)).alias("k"), "text")
    keyed, held = (keyed, "text") if words is None else (coded(keyed, words), "ids")
    group = max(1, min(GROUP, shards // rows.sparkSession.sparkContext.defaultParallelism))
    return keep(keyed.repartitionById(math.ceil(shards / group), F.floor(F.col("shard") / group).cast("int")).sortWithinPartitions("shard", "k", held).select("shard", held), "shards")


def _texts(column, most: int = 1 << 17):
    """(outputs, first positions) of blocks of texts, of a binary column with two bytes for each word; ``most`` words or one text."""
    raw = column.to_pylist()
    size = np.array([len(x) // 2 for x in raw], dtype=np.int64)
    upto, a = np.cumsum(size), 0
    while a < len(raw):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield np.frombuffer(b"".join(raw[a:b]), np.uint16).astype(np.int64), np.concatenate(([0], np.cumsum(size[a:b])))
        a = b


def train(shards: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> WindowNet:
    """A network for each shard, from the common start; the networks are averaged by positions, in a tree of whole numbers, so that no order counts.

    ``shards`` are those of ``sharded``.  A task adds up the networks of its shards and returns one sum.
    """
    spark, net, outside = shards.sparkSession, WindowNet(outputs=words.outputs), words.outputs
    if "ids" not in shards.columns:
        shards = coded(shards, spark.sparkContext.broadcast(words))
    schema, fixed = "seen long, net binary", float(1 << 12)  # sums over 10**14 words stay far below 64 bits

    def said(seen, total):
        return pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["seen", "net"])

    for turn in range(rounds):
        start = spark.sparkContext.broadcast(net.pack())

        def run(batches, start=start, turn=turn):
            fresh = lambda: (WindowNet(outputs=outside).load(np.frombuffer(start.value, np.float32)), 0, [])
            shard, (own, seen, held) = None, fresh()
            every, total = 0, 0

            def steps(last):
                """Train on whole batches of the words held, on all when the shard ends."""
                nonlocal seen, held
                x, y = (np.concatenate(c) for c in zip(*held))
                used = len(y) if last else len(y) // _BATCH * _BATCH
                for k in range(0, used, _BATCH):
                    own.step(x[k : min(used, k + _BATCH)], y[k : min(used, k + _BATCH)])
                seen, held = seen + used, [(x[used:], y[used:])]

            def done():
                """Add the shard's network to the task's sum."""
                nonlocal every, total
                if any(len(y) for _, y in held):
                    steps(True)
                if seen:
                    every, total = every + seen, total + np.rint(np.frombuffer(own.pack(), np.float32).astype(np.float64) * seen * fixed).astype(np.int64)

            for batch in batches:
                ids = batch.column(0).to_numpy()
                cut = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)) if len(ids) else ids
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if ids[a] != shard:
                        done()
                        shard, (own, seen, held) = ids[a], fresh()
                    for out, first in _texts(batch.column(1).slice(a, b - a)):
                        pick = np.flatnonzero(masked_in(turn, np.arange(len(out)) - np.repeat(first[:-1], np.diff(first)), rounds))
                        held.append((_contexts(out, first, pick, outside), out[pick]))
                        if sum(len(y) for _, y in held) >= _BATCH:
                            steps(False)
            done()
            if every:
                yield said(every, total)

        def add(batches):
            seen, total = 0, None
            for batch in batches:
                for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    one = np.frombuffer(b, np.int64)
                    seen, total = seen + s, one if total is None else total + one
            if seen:
                yield said(seen, total)

        nets = keep(shards.mapInArrow(W.tidy(run), schema), "nets")
        many = nets.count()
        while many > 16:
            many = math.ceil(many / 16)  # tasks; what they add up is a row each
            nets, before = keep(nets.coalesce(many).mapInArrow(W.tidy(add), schema), "nets"), nets  # read, not shuffled
            drop(before)
        seen, total = 0, 0
        for r in nets.toLocalIterator():  # 16 networks at most, some at a time
            seen, total = seen + r.seen, total + np.frombuffer(r.net, np.int64)
        drop(nets)
        if seen:
            net = WindowNet(outputs=words.outputs).load(total / (fixed * seen))
    return net


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, score, log_probability of every row of ``docs(doc_id, text)``.

    log_probability is the sum over all words of log P(word | two words on either side), score
    that sum by the number of words.  Words are cut at ASCII white space, A-Z folded, and fall in
    2**CELL_BITS cells by hash; a cell beyond the commonest has the probability of its hashed
    output times its share of that output's count.  Counts and network come from all documents.
    Null texts, empty ones and ones without words have 0 for both.  Repeated rows have equal
    scores, to six places; a null doc_id stays null.  The network is the average of those that
    shards of the rows train; ids and texts decide the shards and the order in them, so that
    scores do not depend on how the rows come.
    """
    rows = text_rows(docs)
    table = keep(counted(rows), "cells")
    words = Vocabulary.of(table)
    sc = rows.sparkSession.sparkContext
    held_words = sc.broadcast(words)
    shards = sharded(rows, held_words)
    net = sc.broadcast(train(shards, words).pack())
    drop(shards)
    held_counts = sc.broadcast(CellCounts(table, words.used))
    drop(table)

    def run(batches):
        words, counts = held_words.value, held_counts.value.of_all()
        model = WindowNet(outputs=words.outputs).load(np.frombuffer(net.value, np.float32))
        size = np.log(np.maximum(words.totals, 1))
        for batch in batches:
            total, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for lo, hi, ids, first, cells, other in _outputs(batch.column(1), words):
                context = _contexts(ids, first, np.arange(len(ids)), words.outputs)
                logs = np.zeros(len(ids) + 1)
                for k in range(0, len(ids), _SCORED):
                    logs[k : min(len(ids), k + _SCORED)] = model.log_probabilities(context[k : k + _SCORED], ids[k : k + _SCORED])
                logs[:-1][other] += np.log(np.maximum(counts[cells[other]], 1)) - size[ids[other] - VOCABULARY]
                many[lo:hi] = np.diff(first)
                total[lo:hi] = np.where(many[lo:hi] > 0, np.add.reduceat(logs, first[:-1]) if hi > lo else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(np.round(total / np.maximum(many, 1), 6)), pa.array(np.round(total, 6))], names=["doc_id", "n_words", "score", "log_probability"])

    return rows.mapInArrow(W.tidy(run), "doc_id long, n_words long, score double, log_probability double")
