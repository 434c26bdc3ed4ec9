"""Best paths: an ordered fold over a sentence, in Arrow batches, and the same fold as a higher-order function."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .batch import best_paths, node_counts, one_by_one, pair_counts
from .lattice import SENT

RANKS = ("User", "System", "Unknown")
TOKEN = "token_pos long, surface string, char_start long, char_end long, byte_start long, byte_end long, lex_type string, word_id long, left_id int, right_id int, word_cost int, total_cost long"


def runs(masks: list[int]) -> list[int]:
    """Run lengths in which neighbours share a category."""
    out = [1] * len(masks)
    for i in range(len(masks) - 2, -1, -1):
        if masks[i] & masks[i + 1]:
            out[i] = out[i + 1] + 1
    return out


def candidates(d, text: str, at: int, base: int, run: int, most_run: int):
    """(end, entries) of the words and unknown words that start at a place, shorter words first, user words before the system's."""
    hits = [(at + n, e) for n in d.starts.get(text[at], ()) if (e := d.words.get(text[at : at + n])) and at + n <= len(text)]
    if d.user:
        split = [(end, [x for x in e if x[0] == rank]) for rank in (0, 1) for end, e in hits]
        hits = [h for h in split if h[1]]
    yield from hits
    invoke, group, length = d.categories[base]
    if hits and not invoke:
        return
    entries, tried = d.unknown.get(base, ()), bool(hits)
    if group and not (most_run and run - 1 > most_run):
        tried = True
        yield at + run, entries
    for n in range(1, min(length, run) + 1):
        if group and n == run:
            continue
        tried = True
        yield at + n, entries
    if not tried:
        yield at + 1, entries


def lattice(d, text: str, ignore_space: bool = False, max_grouping_len: int = 0):
    """Nodes by end place as (start, word_start, entry, best index, cost), and the best entry into EOS; None where no path ends.

    The last of equally cheap left neighbours wins.
    """
    n = len(text)
    infos = [d.info(c) for c in text]
    run = runs([m for _, m in infos])
    space = 1 << d.names["SPACE"] if ignore_space else 0
    ends: list[list[tuple]] = [[] for _ in range(n + 1)]
    ends[0].append((0, 0, (-1, -1, 0, 0, 0), -1, 0))
    node = word = 0
    while word < n:
        if not ends[node]:
            word += 1
            node = word
            continue
        if space & infos[node][1]:
            word += run[node]
        if word >= n:
            break
        best: dict[int, tuple[int, int]] = {}
        left_nodes = ends[node]
        for end, entries in candidates(d, text, word, infos[word][0], run[word], max_grouping_len):
            for e in entries:
                got = best.get(e[2])
                if got is None:
                    row = d.cost[e[2]]
                    got = best[e[2]] = min((ln[4] + int(row[ln[2][3]]), -i) for i, ln in enumerate(left_nodes))
                ends[end].append((node, word, e, -got[1], got[0] + e[4]))
        word += 1
        node = word
    row = d.cost[0]
    last = min(((ln[4] + int(row[ln[2][3]]), -i) for i, ln in enumerate(ends[node])), default=None)
    return ends, node, None if last is None else -last[1]


def path(ends, at: int, index: int) -> list[tuple]:
    """(end, node) of the best path, first token first."""
    out = []
    while at > 0 or ends[at][index][3] >= 0:
        node = ends[at][index]
        out.append((at, node))
        at, index = node[0], node[3]
    return out[::-1]


#: Sentences folded side by side, characters of them, and the fewest that are worth it; longer or fewer ones are folded one by one.
SIDE_BY_SIDE, CHARACTERS, FEWEST = 4096, 1 << 18, 24


def _alike(texts: list[str]) -> tuple[list[list[int]], list[int]]:
    """Groups of sentences of similar length, and those that have too few of their like."""
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
    groups, alone, at = [], [], 0
    while at < len(order):
        shortest, end, size = len(texts[order[at]]), at, 0
        while end < len(order) and end - at < SIDE_BY_SIDE and size < CHARACTERS and len(texts[order[end]]) <= 2 * shortest + 16:
            size += len(texts[order[end]])
            end += 1
        (groups.append(order[at:end]) if end - at >= FEWEST else alone.extend(order[at:end]))
        at = end
    return groups, alone


def _folds(texts: list[str]) -> list[tuple]:
    """(fold, its sentences): side by side or one by one."""
    groups, alone = _alike(texts)
    return [(best_paths, rows) for rows in groups] + [(one_by_one, alone[lo : lo + 64]) for lo in range(0, len(alone), 64)]


def _one_by_one(d, texts, rows, ignore_space, max_grouping_len):
    """(has a path, columns as of ``best_paths``) of sentences that are folded by themselves."""
    has, cols = [], [[] for _ in range(9)]
    for i in rows:
        ends, at, last = lattice(d, texts[i], ignore_space, max_grouping_len)
        has.append(last is not None)
        for end, (_, start, e, _, cost) in path(ends, at, last) if last is not None else ():
            for o, v in zip(cols, (len(has) - 1, start, end, *e, cost)):
                o.append(v)
    return np.array(has, dtype=bool), *(np.array(c, dtype=np.int64) for c in cols)


def tokenize_batches(d, ignore_space: bool = False, max_grouping_len: int = 0, strict: bool = False):
    """A function for mapInArrow: (doc_id, sent_id, text) to one row for each token.

    A sentence without a path to its end gives one row of nulls, or raises when ``strict``;
    tokens of a sentence come in order, sentences in any.
    """

    def run(batches):
        index = d.value.open()
        for batch in batches:
            keys, texts = batch.select(SENT), batch.column(2).to_pylist()
            for fold, rows in _folds(texts):
                has, who, *cols = fold(index, [texts[i] for i in rows], max_grouping_len, ignore_space)
                if strict and not has.all():
                    k = rows[int(np.flatnonzero(~has)[0])]
                    raise InvalidArgument(f"no path through sentence {batch.column(0)[k]}/{batch.column(1)[k]}")
                yield _token_rows(keys, texts, np.array(rows, dtype=np.int64), has, who, *cols)

    return run


def _token_rows(keys, texts, rows, has, who, start, end, rank, word, left, right, cost, total) -> pa.RecordBatch:
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(who)))
    place = np.arange(len(who)) - np.repeat(first, count)
    chosen = [texts[i] for i in rows.tolist()]
    surface = [t[a:b] for t, a, b in zip((chosen[k] for k in who.tolist()), start.tolist(), end.tolist())]
    # bytes before each character, where there are other than single-byte ones
    width = np.zeros(len(chosen) + 1, dtype=np.int64)
    width[1:] = np.cumsum([len(t) + 1 for t in chosen])
    cps = np.frombuffer("\0".join([*chosen, ""]).encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate(([0], np.cumsum(1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF), dtype=np.int64)))
    at = width[who]
    byte = lambda x: before[at + x] - before[at]
    none = np.flatnonzero(~has)
    nulls = lambda t: pa.nulls(len(none), t)
    columns = [place, surface, start, end, byte(start), byte(end), pa.array(np.array(RANKS, dtype=object)[rank], pa.string()), word, left, right, cost, total]
    out = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES[2:])]
    ids = keys.take(pa.array(np.concatenate((rows[who], rows[none]))))
    return pa.RecordBatch.from_arrays([*ids.columns, *(pa.concat_arrays([c, nulls(c.type)]) for c in out)], names=_NAMES)


_NAMES = [*SENT, *(c.strip().split(" ")[0] for c in TOKEN.split(","))]
_TYPES = [pa.int64(), pa.int64(), *({"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.strip().split(" ")[1]] for c in TOKEN.split(","))]


#: Bits of a piece's place in its sentence.
FIRST, LAST = 1, 2
PIECE = "piece string, place int, cnt long"
#: Different pieces, and characters met, up to which a task collects pieces before it sends them.
PIECES, PIECE_CHARACTERS = 1 << 18, 1 << 26


def _piece_rows(pieces: list, place: int, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(np.full(len(pieces), place, dtype=np.int32)), pa.array(counts, pa.int64())], names=["piece", "place", "cnt"])


def cut_batches(fence: tuple[int, str | None] | None):
    """A function for mapInArrow: (text) to (piece, place, cnt) of non-empty sentences.

    With a ``fence`` (that of ``batch.fence``) sentences are cut behind each space, and equal pieces of some
    texts are one row; sentences with a character that may swallow a space are a piece as they are.
    """

    def whole(batches):
        for batch in batches:
            texts = batch.column(0)
            texts = texts.filter(pc.greater(pc.binary_length(texts), 0))
            yield _piece_rows(texts, FIRST | LAST, np.ones(len(texts), dtype=np.int64))

    def run(batches):
        swallows = re.compile(fence[1]).search if fence[1] else lambda text: None
        held, met = [Counter() for _ in range(4)], 0

        def out():
            for place, some in enumerate(held):
                if some:
                    yield _piece_rows(list(some) if place & LAST else [x + " " for x in some], place, list(some.values()))
                    some.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                met += len(text)
                parts = [text] if swallows(text) else text.split(" ")
                if len(parts) > 1 and not parts[-1]:  # a space ends the sentence
                    parts.pop()
                    parts[-1] += " "
                if len(parts) == 1:
                    held[FIRST | LAST][parts[0]] += 1
                else:
                    held[FIRST][parts[0]] += 1
                    held[LAST][parts[-1]] += 1
                    held[0].update(parts[1:-1])
            if met > PIECE_CHARACTERS or sum(map(len, held)) > PIECES:
                yield from out()
                met = 0
        yield from out()

    return run if fence else whole


def _pieces_of(batch, right: int):
    """(texts, right ids of what comes before them, whether they reach their sentence's end, counts) of a batch of pieces."""
    place = batch.column(1).to_numpy()
    return batch.column(0).to_pylist(), np.where(place & FIRST, 0, right).astype(np.int64), (place & LAST) > 0, batch.column(2).to_numpy()


def count_batches(d, right: int = 0, ignore_space: bool = False, max_grouping_len: int = 0):
    """A function for mapInArrow: PIECE rows to (side, id, cnt) over all adjacent reachable pairs of a batch; ``right`` is the right id of the space's word."""

    def run(batches):
        index = d.value.open()
        for batch in batches:
            (texts, begin, whole, weight), total = _pieces_of(batch, right), {}
            groups, alone = _alike(texts)
            for rows in [*groups, *([i] for i in alone)]:
                for side, (ids, counts) in pair_counts(index, [texts[i] for i in rows], max_grouping_len, ignore_space, begin[rows], whole[rows], weight[rows]).items():
                    for i, c in zip(ids.tolist(), counts.tolist()):
                        total[side, i] = total.get((side, i), 0) + c
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in total], pa.string()), pa.array([i for _, i in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["side", "id", "cnt"])

    return run


NODE_COUNT = "lex_rank int, word_id long, n_chars long, cnt long, ix_sum long"


def node_batches(d, max_grouping_len: int = 0):
    """A function for mapInArrow: PIECE rows to (lex_rank, word_id, n_chars, cnt, ix_sum) of the nodes of a batch's lattices, reached or not."""

    def run(batches):
        index = d.value.open()
        for batch in batches:
            texts, _, _, weight = _pieces_of(batch, 0)
            groups, alone = _alike(texts)
            for rows in [*groups, *([i] for i in alone)]:
                cols = node_counts(index, [texts[i] for i in rows], weight[rows], max_grouping_len)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(cols)], names=["lex_rank", "word_id", "n_chars", "cnt", "ix_sum"])

    return run


SURFACE_COUNT = "surface string, lex_type string, cnt long, least_cost int"


def surface_batches(d, right: int = 0, ignore_space: bool = False, max_grouping_len: int = 0):
    """A function for mapInArrow: PIECE rows to (surface, lex_type, cnt, least_cost) of the tokens of a batch; a sentence without a path counts as a row of nulls."""

    def run(batches):
        index = d.value.open()
        for batch in batches:
            (texts, begin, _, weight), total = _pieces_of(batch, right), {}
            for fold, rows in _folds(texts):
                some, many = [texts[i] for i in rows], weight[rows]
                has, who, start, end, rank, _, _, _, cost, _ = fold(index, some, max_grouping_len, ignore_space, begin[rows])
                for k, a, b, r, c, n in zip(who.tolist(), start.tolist(), end.tolist(), rank.tolist(), cost.tolist(), many[who].tolist()):
                    key = some[k][a:b], r
                    got = total.get(key)
                    total[key] = (n, c) if got is None else (got[0] + n, min(got[1], c))
                if not has.all():
                    total[None, None] = (total.get((None, None), (0, None))[0] + int(many[~has].sum()), None)
            kinds = [None if r is None else RANKS[r] for _, r in total]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in total], pa.string()), pa.array(kinds, pa.string()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([c for _, c in total.values()], pa.int32())], names=["surface", "lex_type", "cnt", "least_cost"])

    return run


TOTAL = "doc_id long, n_tokens long, most long"


def total_batches(d, ignore_space: bool = False, max_grouping_len: int = 0):
    """A function for mapInArrow: (doc_id, text) to (doc_id, n_tokens, most) of each sentence: tokens, and the largest total cost up to one.

    Sentences without tokens have no row, those without a path 0 and null.
    """

    def folded(index, texts):
        has, count, most = np.ones(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for fold, some in _folds(texts):
            reached, who, *_, total = fold(index, [texts[i] for i in some], max_grouping_len, ignore_space)
            some, first = np.array(some, dtype=np.int64), np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
            has[some], count[some] = reached, np.bincount(who, minlength=len(some))
            if len(first):
                most[some[who[first]]] = np.maximum.reduceat(total, first)
        return has, count, most

    def run(batches):
        index = d.value.open()
        stretches = index.stretches(ignore_space)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            has, count, most = folded(index, texts) if stretches is None else stretches.totals([t or "" for t in texts], max_grouping_len)
            use = np.flatnonzero((count > 0) | ~has)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use)), pa.array(count[use], pa.int64()), pa.array(most[use], pa.int64(), mask=count[use] == 0)], names=["doc_id", "n_tokens", "most"])

    return run


def best_path_fold(nodes: DataFrame, sentences: DataFrame, cost: list[list[int]]) -> DataFrame:
    """(doc_id, sent_id, path, cost): the fold as one aggregate over each sentence's nodes, all in the JVM.

    For short sentences and small matrices: every entry carries its path.  Without
    space skipping; a sentence without a path to its end has nulls.
    """
    table = F.array(*[F.array(*[F.lit(int(c)).cast("bigint") for c in row]) for row in cost])
    conn = lambda left, right: F.get(F.get(table, left), right)
    keyed = nodes.groupBy(*SENT).agg(F.sort_array(F.collect_list(F.struct("start", "lex_rank", "word_id", "end", "left_id", "right_id", "word_cost"))).alias("nodes"))
    rows = keyed.join(sentences.select(*SENT, F.length("text").cast("long").alias("n")), SENT)
    entry = "array<struct<end:bigint,right_id:int,cost:bigint,path:array<struct<start:bigint,end:bigint,lex_rank:int,word_id:bigint>>>>"
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("right_id"), F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<struct<start:bigint,end:bigint,lex_rank:int,word_id:bigint>>").alias("path"))).cast(entry)

    def best(entries, left):
        return F.array_min(F.transform(entries, lambda x, i: F.struct((x.cost + conn(left, x.right_id)).alias("cost"), (-i).alias("i"), x.path.alias("path"))))

    def step(acc, n):
        live = F.filter(acc, lambda x: x.end >= n.start)
        here = F.filter(live, lambda x: x.end == n.start)
        chosen = best(here, n.left_id)
        own = F.struct(n.start.alias("start"), n.end.alias("end"), n.lex_rank.alias("lex_rank"), n.word_id.alias("word_id"))
        new = F.struct(n.end.alias("end"), n.right_id.alias("right_id"), (chosen.cost + n.word_cost).alias("cost"), F.concat(chosen.path, F.array(own)).alias("path"))
        return F.when(F.size(here) == 0, acc).otherwise(F.concat(live, F.array(new)).cast(entry))

    done = rows.withColumn("acc", F.aggregate("nodes", start, step))
    last = best(F.filter("acc", lambda x: x.end == F.col("n")), F.lit(0))
    return done.withColumn("last", last).select(*SENT, F.col("last.path").alias("path"), F.col("last.cost").alias("cost"))
