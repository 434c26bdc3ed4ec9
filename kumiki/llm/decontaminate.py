"""Benchmark passages in training texts: BM25 over word shingles with block-max WAND, then checked overlap of question and answer."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import keep, text_rows

K1, B = 1.2, 0.75
SHINGLE = 5
#: Share of the shingles of an item's question, and of its answer, that a text must hold.
OVERLAP = 0.75
#: Text of test items that one index holds, and bytes of indexes that a worker holds in a pass over the documents; larger tables take more passes.
INDEX_BYTES, HELD_BYTES = 1 << 20, 500_000_000
_BLOCK = 16
_SPACES = " \t\n\x0b\x0c\r"


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = W.split(raw, np.array([0, len(raw)]))
    return W.hashes(raw, starts, ends)


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item: what stands before its last line, and that line; without a line feed all is question."""
    text = text.strip(_SPACES)
    cut = text.rfind("\n")
    return (text[:cut], text[cut + 1 :]) if cut >= 0 else (text, "")


class _Lists:
    """Postings of terms in flat arrays; one term's come as lists."""

    def __init__(self, start: np.ndarray, items: np.ndarray, impacts: np.ndarray):
        self.start, self.items, self.impacts = start, items, impacts

    def __getitem__(self, t: int) -> tuple[list[int], list[float]]:
        a, b = self.start[t], self.start[t + 1]
        return self.items[a:b].tolist(), self.impacts[a:b].tolist()


class BlockMaxIndex:
    """Postings of items by shingle in flat arrays, with the largest impact of every block of postings.

    Impacts are BM25 weights over the least score that an item can have when the
    overlaps hold: the sum of its lightest shingles that suffice.  So an item with
    enough overlap scores 1 or more, and all above 1 are retrieved.  An index takes some
    40 bytes for each word of its items: their words' hashes, and term, posting and impact.
    """

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE):
        self.shingle, self.ids, words, cuts, grams, owner = shingle, [], [], [], [], []
        for item_id, text in items:
            whole, parts = _words(text), [_words(part) for part in parts_of(text)]
            if not len(whole):
                continue
            for part in parts:
                if len(part):
                    grams.append(W.grams(part, min(shingle, len(part))))
                    owner.append(np.full(len(grams[-1]), len(self.ids), dtype=np.int64))
            self.ids.append(item_id)
            words.append(whole)
            cuts.append(len(parts[0]))  # a part's words are the whole text's: parts are cut at white space
        n = len(self.ids)
        none = np.zeros(0, np.uint64)
        self.words, self.cuts = np.concatenate(words) if words else none, np.array(cuts, dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        self.lengths = sorted({k for w, c in zip(words, cuts) for k in (min(shingle, len(w)), min(shingle, c), min(shingle, len(w) - c)) if k})
        g, k = (np.concatenate(x) if x else none for x in (grams, owner))
        self.terms, term = np.unique(g, return_inverse=True)
        pairs, tf = np.unique(term.astype(np.int64) * max(n, 1) + k.astype(np.int64), return_counts=True)
        term, item = pairs // max(n, 1), pairs % max(n, 1)
        start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        length = np.bincount(item, tf, minlength=n)
        held = np.diff(start)
        idf = np.log(1 + (n - held + 0.5) / (held + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / (length.mean() if n else 1.0)))
        by_item = np.argsort(item, kind="stable")
        first = np.searchsorted(item[by_item], np.arange(n + 1))
        least = np.ones(n)
        for i in range(n):
            own = by_item[first[i] : first[i + 1]]
            known, weight = self.terms[term[own]], impact[own]  # terms rise, as pairs do
            sets = self._sets(i)
            needs = [np.sort(weight[np.searchsorted(known, s)])[: math.ceil(OVERLAP * len(s))].sum() for s in sets]
            least[i] = max(needs) if len(np.intersect1d(*sets)) else sum(needs)  # a shingle of both parts scores once
        self.lists = _Lists(start.astype(np.int32), item.astype(np.int32), impact / least[item])
        self.most = np.maximum.reduceat(self.lists.impacts, start[:-1]) if len(self.terms) else np.zeros(0)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def _sets(self, item: int) -> list[np.ndarray]:
        """The shingles of an item's question and answer."""
        own, cut = self.words[self.at[item] : self.at[item + 1]], self.cuts[item]
        return [W.shingle_set(part, self.shingle) for part in (own[:cut], own[cut:])]

    @staticmethod
    def _blocks(items: list[int], impacts: list[float]) -> tuple[list[int], list[float]]:
        """Last item and largest impact of each block."""
        return [items[min(k + _BLOCK, len(items)) - 1] for k in range(0, len(items), _BLOCK)], [max(impacts[k : k + _BLOCK]) for k in range(0, len(items), _BLOCK)]

    @property
    def nbytes(self) -> int:
        """Bytes that its arrays hold."""
        arrays = (self.words, self.cuts, self.at, self.terms, self.most, self.maybe, self.lists.start, self.lists.items, self.lists.impacts)
        return sum(a.nbytes for a in arrays) + 40 * len(self.ids)

    def search(self, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """All items that score ``threshold`` or more for the distinct query terms, by block-max WAND."""
        threshold -= 1e-9
        lists = {t: self.lists[t] for t in terms}
        blocks = {t: self._blocks(*own) for t, own in lists.items()}
        most = {t: max(best) for t, (_, best) in blocks.items()}
        cursor = [[lists[t][0][0], 0, t] for t in terms]
        found = []
        while cursor:
            cursor.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursor):
                bound += most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == doc:
                pivot += 1
            tight, ends = 0.0, 1 << 60
            for _, place, t in cursor[: pivot + 1]:
                last, best = blocks[t]
                b = place // _BLOCK
                while b < len(last) and last[b] < doc:
                    b += 1
                if b < len(last):
                    tight += best[b]
                    ends = min(ends, last[b])
            if tight < threshold:
                nxt = ends + 1 if ends < 1 << 60 else doc + 1
                if pivot + 1 < len(cursor):
                    nxt = min(nxt, cursor[pivot + 1][0])
                self._advance(lists, blocks, cursor, pivot + 1, max(nxt, doc + 1))
            elif cursor[0][0] == doc:
                score = sum(lists[t][1][p] for _, p, t in cursor[: pivot + 1])
                if score >= threshold:
                    found.append((doc, score))
                self._advance(lists, blocks, cursor, pivot + 1, doc + 1)
            else:
                first = next(k for k in range(pivot + 1) if cursor[k][0] == doc)
                self._advance(lists, blocks, cursor, first, doc)
        return found

    @staticmethod
    def _advance(lists, blocks, cursor, many, doc):
        for c in cursor[:many]:
            docs, place = lists[c[2]][0], c[1]
            last = blocks[c[2]][0]
            b = place // _BLOCK
            while b < len(last) and last[b] < doc:
                b += 1
            place = max(place, b * _BLOCK)
            while place < len(docs) and docs[place] < doc:
                place += 1
            c[0], c[1] = (docs[place], place) if place < len(docs) else (1 << 61, place)
        cursor[:] = [c for c in cursor if c[0] < 1 << 61]

    def queries(self, grams: dict[int, np.ndarray], first: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(document, terms) of the documents whose terms' largest impacts can reach 1; ``grams`` has those of all words by length."""
        docs, terms = [], []
        for k, g in grams.items():
            at = np.flatnonzero(self.maybe[(g >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            t = np.minimum(np.searchsorted(self.terms, g[at]), len(self.terms) - 1)
            hit = self.terms[t] == g[at]
            at, t = at[hit], t[hit]
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + k <= first[doc + 1]
            docs.append(doc[inside])
            terms.append(t[inside])
        if not docs:
            return []
        pairs = np.unique(np.concatenate(docs) * len(self.terms) + np.concatenate(terms))
        doc, term = pairs // len(self.terms), pairs % len(self.terms)
        cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else doc
        bound = np.add.reduceat(self.most[term], cut) if len(doc) else []
        ends = np.append(cut[1:], len(doc))
        return [(int(doc[a]), term[a:b]) for a, b, most in zip(cut, ends, bound) if most >= 1 - 1e-9]

    def matches(self, grams: dict[int, np.ndarray], first: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
        """(document, item id, score, overlap, question overlap, answer overlap) of each item verified in a document."""
        out = []
        for doc, terms in self.queries(grams, first) if len(self.terms) else ():
            held = self.terms[terms]
            for item, score in self.search(terms.tolist()):
                question, answer = (float(np.isin(s, held).mean()) if len(s) else 1.0 for s in self._sets(item))
                if min(question, answer) >= OVERLAP:
                    item_id, own = self.ids[item], self.words[self.at[item] : self.at[item + 1]]
                    whole, size = W.shingle_set(own, self.shingle), min(self.shingle, len(own))
                    every = np.isin(whole, grams[size][first[doc] : first[doc + 1] - size + 1])
                    out.append((doc, item_id, score, float(every.mean()), question, answer))
        return out


def _indexes(items: DataFrame):
    """Broadcast indexes that together hold all items with a text and an item_id, in lists of at most HELD_BYTES."""
    held = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / INDEX_BYTES))
    if parts > 1:
        held = keep(held, "items")
    passes, room = [], 0
    for part in range(parts):
        own = held if parts == 1 else held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        index = BlockMaxIndex([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()])
        if not passes or index.nbytes > room:
            passes.append([])
            room = HELD_BYTES
        room -= index.nbytes
        passes[-1].append(items.sparkSession.sparkContext.broadcast(index))
    return passes


def _found(column: pa.Array, indexes):
    """(row, item id, ...) of all items of the indexes in each text; words are hashed once."""
    lengths = sorted({k for index in indexes for k in index.value.lengths})
    for lo, _, buf, offs in W.blocks(column):
        starts, ends, first = W.split(buf, offs)
        h = W.hashes(buf, starts, ends)
        grams = {k: W.grams(h, k) for k in lengths}
        for index in indexes:
            for m in index.value.matches({k: grams[k] for k in index.value.lengths}, first):
                yield lo + m[0], *m[1:]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): test items found in each text.

    Every whole text is a query; all items whose BM25 score shows that the overlaps may
    hold are retrieved, and an item is reported when the text holds three quarters of
    the five-word shingles of its question and three quarters of those of its answer,
    wherever they stand (words cut at ASCII white space, A-Z folded; a part of fewer
    words is one shingle of its own length).  The question is an item's text before its
    last line, the answer that line; without a line feed all is question, and an empty
    part overlaps fully.  ``overlap`` is the share of the shingles of the whole item.
    Null and empty texts hold nothing, null and empty items are never found, rows
    without doc_id are read but not named.  Repeated rows of either table give one
    row for each doc_id and item_id, with the largest figures.
    """
    rows, out = text_rows(docs), None
    for indexes in _indexes(items):

        def run(batches, indexes=indexes):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = [(ids[row], *more) for row, *more in _found(batch.column(1), indexes) if ids[row] is not None]
                cols = list(zip(*got)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(W.tidy(run), "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionAll(found)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")])


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, each decided by its own text; all columns stay."""
    at = docs.columns.index("text")
    for indexes in _indexes(items):

        def run(batches, indexes=indexes):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in _found(batch.column(at).cast(pa.string()), indexes):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(W.tidy(run), docs.schema)
    return docs
