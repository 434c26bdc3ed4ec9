"""Lattices of many sentences at once: numpy steps from place to place, each for all sentences of a batch."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << np.int64(60)
#: Node and left-neighbour pairs of one step at most; more are taken in pieces.
PAIRS = 1 << 20
#: Cells of a matrix up to which a place holds the cheapest of its nodes by right id, in whole arrays.
DENSE = 1 << 10
#: Costs of single pairs that a worker remembers for sentences folded by themselves.
HELD_COSTS = 1 << 18


def hashes(cps: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of strings one character longer."""
    h = (before + cps.astype(np.uint64) + _U(1)) * _BASE
    return h ^ (h >> _U(29))


class Index:
    """A dictionary as arrays: words as a trie of prefix hashes, their entries, character and unknown-word tables, costs.

    Words are numbered by length, then hash.  This one is made of a compact dictionary; ``mapped.Mapped`` opens one from files.
    """

    def __init__(self, d):
        surfaces = list(d.words)
        cps = np.frombuffer("".join(surfaces).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(s) for s in surfaces], dtype=np.int64)
        first = np.cumsum(size) - size
        h, whole, live, prefixes = np.zeros(len(surfaces), dtype=np.uint64), np.zeros(len(surfaces), dtype=np.uint64), np.arange(len(surfaces)), []
        for n in range(1, int(size.max(initial=0)) + 1):
            h = hashes(cps[first[live] + n - 1], h)
            done = size[live] == n
            whole[live[done]] = h[done]
            h, live = h[~done], live[~done]
            prefixes.append(np.unique(h))
        order = np.lexsort((whole, size))
        surfaces = [surfaces[i] for i in order]
        self.entries = np.array([e for s in surfaces for e in d.words[s]], dtype=np.int64).reshape(-1, 5)
        self.set_words(np.frombuffer("".join(surfaces).encode("utf-32-le"), dtype=np.uint32), size[order], whole[order], np.array([len(d.words[s]) for s in surfaces], dtype=np.int64), prefixes)
        cates = max(d.categories) + 1
        points = np.array([(cp, *v) for cp, v in d.points.items()], dtype=np.int64).reshape(-1, 3)
        categories = np.zeros((cates, 3), dtype=np.int64)
        for k, row in d.categories.items():
            categories[k] = row
        unknown = [(k, *e) for k in range(cates) for e in d.unknown.get(k, ())]
        self.set_characters(points, categories, np.array(unknown, dtype=np.int64).reshape(-1, 6), d.names.get("SPACE"))
        self.cost = d.cost if not isinstance(d.cost, list) else np.array(d.cost, dtype=np.int64)

    def set_words(self, text: np.ndarray, size: np.ndarray, whole: np.ndarray, many: np.ndarray, prefixes: list[np.ndarray]) -> None:
        """Characters, lengths, hashes and numbers of entries of the words in order, and for each length the sorted hashes of longer words' prefixes."""
        self.text, self.size, self.many = text, size, many
        self.first, self.at = np.cumsum(size) - size, np.cumsum(many) - many
        top = int(size[-1]) if len(size) else 0
        start = np.searchsorted(size, np.arange(1, top + 2))
        #: For each length: prefixes of longer words, words, and the number of the first word.
        self.levels = [(prefixes[n], whole[start[n] : start[n + 1]], int(start[n])) for n in range(top)]

    def set_characters(self, points: np.ndarray, categories: np.ndarray, unknown: np.ndarray, space: int | None) -> None:
        """(code point, base, categories), (invoke, group, length) by category, (category, entry...) in order of category, and the category of spaces."""
        self.base, self.mask = np.zeros(1 << 16, dtype=np.int64), np.ones(1 << 16, dtype=np.int64)
        self.base[points[:, 0]], self.mask[points[:, 0]] = points[:, 1], points[:, 2]
        self.invoke, self.group, self.length = categories.T
        self.unknown = unknown[:, 1:]
        self.unk_many = np.bincount(unknown[:, 0], minlength=len(categories))
        self.unk_at = np.cumsum(self.unk_many) - self.unk_many
        self.space = 0 if space is None else 1 << space
        self.single: dict[tuple[int, int], int] = {}
        self.held_stretches: dict[bool, object] = {}

    def conn(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Costs of nodes with these left ids after nodes with these right ids."""
        if isinstance(self.cost, np.ndarray):
            return self.cost[left, right].astype(np.int64)
        if hasattr(self.cost, "conn"):
            return self.cost.conn(left, right)
        out, order = np.empty(len(left), dtype=np.int64), np.argsort(left, kind="stable")
        cut = np.flatnonzero(np.append(True, left[order][1:] != left[order][:-1])) if len(left) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(left)]):
            out[order[a:b]] = self.cost[int(left[order[a]])][right[order[a:b]]]
        return out

    def one(self, left: int, right: int) -> int:
        """The cost of one pair."""
        got = self.single.get((left, right))
        if got is None:
            if len(self.single) >= HELD_COSTS:
                self.single.clear()
            got = self.single[left, right] = int(self.conn(np.array([left]), np.array([right]))[0])
        return got

    def stretches(self, ignore_space: bool):
        """``Stretches`` of the dictionary, made once in each worker, or None."""
        from .stretches import Stretches

        if ignore_space not in self.held_stretches:
            self.held_stretches[ignore_space] = Stretches.of(self, ignore_space)
        return self.held_stretches[ignore_space]


def fence(ix: Index) -> tuple[int, str | None] | None:
    """(right id of the space's word, pattern of the characters beside which it may be another), if sentences may be cut behind every space.

    They may where the space is one word, no other word has it, no unknown word begins with it
    and none runs over it: then all paths go through its word, and what comes after it depends on that word's right id
    alone.  Unknown words run over it only from characters of its categories, which the pattern finds.  Every category must have an
    unknown entry, so that every sentence has a path.
    """
    space = ord(" ")
    words = np.flatnonzero(ix.text[ix.first[: np.searchsorted(ix.size, 1, side="right")]] == space)
    beside = np.flatnonzero(ix.mask & ix.mask[space])
    if len(words) != 1 or ix.many[words[0]] != 1 or np.count_nonzero(ix.text == space) != 1 or ix.invoke[ix.base[space]] or not ix.unk_many.all() or len(beside) > 64 or beside[0] == 0:
        return None
    beside = "".join(re.escape(chr(c)) for c in beside if c != space)
    return int(ix.entries[ix.at[words[0]]][3]), f"[{beside}]" if beside else None


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: the row that each of their units belongs to, and its place there."""
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _order(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The order by one number, then by another; packed into one where both fit."""
    most = int(then.max(initial=0)) + 1
    if int(first.max(initial=0)) < (1 << 62) // most:
        return np.argsort(first * most + then)
    return np.lexsort((then, first))


def _matches(ix: Index, cps: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, word) of every word at every place; ``left`` has the characters from a place to its sentence's end."""
    at, h = np.arange(len(cps)), np.zeros(len(cps), dtype=np.uint64)
    places, words = [], []
    for n, (prefixes, whole, number) in enumerate(ix.levels, 1):
        room = left[at] >= n
        at, h = at[room], h[room]
        if not len(at):
            break
        h = hashes(cps[at + n - 1], h)
        if len(whole):
            k = np.minimum(np.searchsorted(whole, h), len(whole) - 1)
            hit = whole[k] == h
            g, w = at[hit], number + k[hit]
            row, j = _spread(np.full(len(g), n))  # the characters themselves decide
            same = np.bincount(row[cps[g[row] + j] == ix.text[ix.first[w[row]] + j]], minlength=len(g)) == n
            places.append(g[same])
            words.append(w[same])
        if not len(prefixes):
            break
        k = np.minimum(np.searchsorted(prefixes, h), len(prefixes) - 1)
        on = prefixes[k] == h
        at, h = at[on], h[on]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(places), np.concatenate(words)) if places else (none, none)


def _unknown(ix: Index, base: np.ndarray, run: np.ndarray, matched: np.ndarray, most_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the unknown words."""
    at = np.flatnonzero(~matched | (ix.invoke[base] > 0))
    b, r = base[at], run[at]
    group = ix.group[b] > 0
    whole = group & ~((most_run > 0) & (r - 1 > most_run))
    places, lengths, tried = [at[whole]], [r[whole]], matched[at] | whole
    for n in range(1, int(ix.length.max(initial=0)) + 1):
        use = (n <= np.minimum(ix.length[b], r)) & ~(group & (n == r))
        places.append(at[use])
        lengths.append(np.full(int(use.sum()), n))
        tried |= use
    places.append(at[~tried])
    lengths.append(np.ones(int((~tried).sum()), dtype=np.int64))
    return np.concatenate(places), np.concatenate(lengths)


@dataclass
class Lattice:
    """All words of some sentences, whether a path reaches them or not.

    Nodes: first the beginning of each sentence, then the words in order of the place where
    they start, of the sentence, of rank and number; ``key`` of their starts rises.
    """

    size: np.ndarray
    off: np.ndarray
    run: np.ndarray
    blank: np.ndarray | None
    who: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rank: np.ndarray
    word: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cost: np.ndarray

    @property
    def many(self) -> int:
        return len(self.size)

    def spot(self, who: np.ndarray, at) -> np.ndarray:
        """The number of a place of a sentence; a sentence of n characters has n + 1."""
        return self.off[who] + who + at


def lattice(ix: Index, texts: list[str], most_run: int = 0, ignore_space: bool = False, begin: np.ndarray | None = None) -> Lattice:
    """``begin``: right ids of what comes before the texts, where they are not whole sentences."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    off = np.cumsum(size) - size
    cps = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sent = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(cps)) - off[sent]
    known = np.where(cps < 65536, cps, 0)
    base, mask = ix.base[known], ix.mask[known]
    cut = np.ones(len(cps), dtype=bool)
    cut[:-1] = ((mask[:-1] & mask[1:]) == 0) | (sent[:-1] != sent[1:])
    run = np.minimum.accumulate(np.where(cut, np.arange(len(cps)), len(cps))[::-1])[::-1] - np.arange(len(cps)) + 1
    g, word = _matches(ix, cps, size[sent] - place)
    matched = np.zeros(len(cps), dtype=bool)
    matched[g] = True
    row, k = _spread(ix.many[word])
    lex, lex_g, lex_n = ix.entries[ix.at[word[row]] + k], g[row], ix.size[word[row]]
    g, n = _unknown(ix, base, run, matched, most_run)
    row, k = _spread(ix.unk_many[base[g]])
    unk, unk_g, unk_n = ix.unknown[ix.unk_at[base[g[row]]] + k], g[row], n[row]
    g, n, e = np.concatenate((lex_g, unk_g)), np.concatenate((lex_n, unk_n)), np.concatenate((lex, unk)).astype(np.int64)
    s, start = sent[g], place[g]
    order = _order(start * len(texts) + s, e[:, 0] * (int(e[:, 1].max(initial=0)) + 1) + e[:, 1])
    s, start, n, e = s[order], start[order], n[order], e[order]
    zero = np.zeros(len(texts), dtype=np.int64)
    fields = (np.concatenate((zero if c != 3 or begin is None else begin, e[:, c])) for c in range(5))
    blank = (mask & ix.space) > 0 if ignore_space else None
    return Lattice(size, off, run, blank, np.concatenate((np.arange(len(texts)), s)), np.concatenate((zero, start)), np.concatenate((zero, start + n)), *fields)


def _walk(x: Lattice, visit) -> np.ndarray:
    """Take the places from left to right: ``visit(nodes, at)`` gets the words that start there and says which of them are reached.

    Where spaces are ignored, the words after a run of spaces start at the run's first
    reachable place, and its other places, with the one after it, start none.  Returns the
    place of each sentence's end: the run of spaces that closes it, or its last character.
    """
    many, end = x.many, x.size.copy()
    if x.blank is None:
        step = np.searchsorted(x.start[many:], np.arange(int(x.size.max(initial=0)) + 1)) + many
        for t in range(len(step) - 1):
            if step[t] < step[t + 1]:
                visit(np.arange(step[t], step[t + 1]), t)
        return end
    reached = np.zeros(int(x.size.sum()) + many, dtype=bool)
    reached[x.spot(np.arange(many), 0)] = True
    after, starts = np.zeros(many, dtype=np.int64), x.spot(x.who[many:], x.start[many:])
    count, first = np.bincount(starts, minlength=len(reached)), np.zeros(len(reached), dtype=np.int64)
    new = np.flatnonzero(np.append(True, starts[1:] != starts[:-1])) if len(starts) else starts
    first[starts[new]] = new + many
    for t in range(int(x.size.max(initial=0))):
        s = np.flatnonzero((x.size > t) & (after <= t))
        s = s[reached[x.spot(s, t)]]
        at = x.off[s] + t
        word = t + np.where(x.blank[at], x.run[at], 0)
        over = word >= x.size[s]
        end[s[over]], after[s[over]] = t, x.size[s[over]] + 1
        s, word = s[~over], word[~over]
        after[s] = word + 1
        at = x.spot(s, word)
        row, k = _spread(count[at])
        if len(row):
            nodes = first[at][row] + k
            ok = nodes[visit(nodes, t)]
            reached[x.spot(x.who[ok], x.end[ok])] = True
    return end


def _walk_one(x: Lattice, visit) -> int:
    """``_walk`` for one sentence, without an array for each place: ``visit(nodes, at)`` gets a range and says whether ``at`` is reached."""
    size = int(x.size[0])
    step = (np.searchsorted(x.start[1:], np.arange(size + 1)) + 1).tolist()
    if x.blank is None:
        for t in range(size):
            if step[t] < step[t + 1]:
                visit(range(step[t], step[t + 1]), t)
        return size
    blank, run, t, none = x.blank.tolist(), x.run.tolist(), 0, range(0)
    while t < size:
        word = t + (run[t] if blank[t] else 0)
        if word >= size:
            if visit(none, t):
                return t
            t += 1
        else:
            t = word + 1 if visit(range(step[word], step[word + 1]), t) else t + 1
    return size


def _by_right(ix: Index, x: Lattice):
    """For ``best_paths`` with a small matrix: (put, relax) over the cheapest node of each right id at each place, or None where numbers would pass 64 bits.

    A number holds a node's total cost and, below it, how far the node is from the last, so that the least number
    is the cheapest node and the last of equally cheap ones.
    """
    if not isinstance(ix.cost, np.ndarray) or ix.cost.size > DENSE:
        return None
    bits = len(x.who).bit_length()
    most = (int(np.abs(x.cost).max(initial=0)) + int(np.abs(ix.cost.astype(np.int64)).max(initial=0))) * (int(x.size.max(initial=0)) + 2)
    if most >= 1 << (60 - bits):
        return None
    far, low = np.int64(1) << np.int64(62), (1 << bits) - 1
    conn = np.ascontiguousarray(ix.cost.T.astype(np.int64)) << bits
    lefts, rights = ix.cost.shape
    held = np.full((int(x.size.sum()) + x.many, rights), far)
    flat, cell = held.reshape(-1), x.spot(x.who, x.end) * rights + x.right

    def put(nodes, total):
        np.minimum.at(flat, cell[nodes], (total << bits) | (low - nodes))

    def relax(at, owner, left_id, add):
        turn = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        here = held[x.spot(owner[turn], at if np.ndim(at) == 0 else at[turn])]
        least = here[:, :1] + conn[0]
        for r in range(1, rights):
            np.minimum(least, here[:, r : r + 1] + conn[r], out=least)
        got = least[np.repeat(np.arange(len(turn)), np.diff(np.append(turn, len(owner)))), left_id]
        reached = got < far >> 1
        return np.where(reached, (got >> bits) + add, _FAR), np.where(reached, low - (got & low), -1)

    return put, relax


def best_paths(ix: Index, texts: list[str], most_run: int = 0, ignore_space: bool = False, begin: np.ndarray | None = None):
    """(has a path, token's sentence, start, end, rank, word id, left id, right id, word cost, total cost) of non-empty sentences.

    Tokens come by sentence and place.  Of equally cheap left neighbours the last wins: that
    of the latest start, user words before the system's before unknown ones, then of the largest word id.
    """
    x = lattice(ix, texts, most_run, ignore_space, begin)
    many = x.many
    total, back = np.full(len(x.who), _FAR), np.full(len(x.who), -1)
    total[:many] = 0
    dense = _by_right(ix, x)
    if dense is None:
        # Nodes by the place where they end, in the order in which they would be put there.
        key = x.end * many + x.who
        ends = _order(key, np.arange(len(key)))
        key = key[ends]

    def by_pairs(at, owner, left_id, add):
        """Best left neighbours of nodes that start at ``at``: costs and their numbers."""
        lo, hi = np.searchsorted(key, at * many + owner), np.searchsorted(key, at * many + owner, side="right")
        best, chosen = np.full(len(owner), _FAR), np.full(len(owner), -1)
        count = hi - lo
        use = np.flatnonzero(count)
        if not len(use):
            return best, chosen
        for a, b in _pieces(count[use]):
            own = use[a:b]
            row, j = _spread(count[own])
            other = ends[lo[own][row] + j]
            value = total[other] + ix.conn(left_id[own][row], x.right[other])
            first = np.cumsum(count[own]) - count[own]
            least = np.minimum.reduceat(value, first)
            last = np.maximum.reduceat(np.where(value == least[row], np.arange(len(row)), -1), first)
            reached = least < _FAR // 2
            best[own[reached]] = least[reached] + add[own[reached]]
            chosen[own[reached]] = other[last[reached]]
        return best, chosen

    put, relax = dense or (None, by_pairs)

    def visit(nodes, t):
        total[nodes], back[nodes] = relax(t, x.who[nodes], x.left[nodes], x.cost[nodes])
        ok = back[nodes] >= 0
        if put:
            put(nodes[ok], total[nodes[ok]])
        return ok

    if put:
        put(np.arange(many), total[:many])
    end, zero = _walk(x, visit), np.zeros(many, dtype=np.int64)
    _, at = relax(end, np.arange(many), zero, zero)
    has = at >= 0
    out, live = [], at[at >= many]
    while len(live):
        out.append(live)
        live = back[live]
        live = live[live >= many]
    path = np.concatenate(out) if out else zero[:0]
    path = path[_order(x.who[path], x.start[path])]
    return (has, *(c[path] for c in (x.who, x.start, x.end, x.rank, x.word, x.left, x.right, x.cost, total)))


def one_by_one(ix: Index, texts: list[str], most_run: int = 0, ignore_space: bool = False, begin: np.ndarray | None = None):
    """What ``best_paths`` gives, each sentence folded by itself: for long sentences, of which there are few."""
    has, cols = [], [[] for _ in range(9)]
    for i, text in enumerate(texts):
        x = lattice(ix, [text], most_run, ignore_space, None if begin is None else begin[i : i + 1])
        left, right, cost, until = (c.tolist() for c in (x.left, x.right, x.cost, x.end))
        total, back = [0] + [None] * (len(left) - 1), [-1] * len(left)
        ends: list[list[int]] = [[] for _ in range(len(text) + 1)]
        ends[0].append(0)

        def best(at, left_id):
            return min(((total[k] + ix.one(left_id, right[k]), -i, k) for i, k in enumerate(ends[at])), default=None)  # noqa: B023

        def visit(nodes, t):
            by: dict[int, tuple] = {}
            ok = bool(ends[t])  # noqa: B023
            for k in nodes if ok else ():
                got = by.get(left[k])  # noqa: B023
                if got is None:
                    got = by[left[k]] = best(t, left[k])  # noqa: B023
                total[k], back[k] = got[0] + cost[k], got[2]  # noqa: B023
                ends[until[k]].append(k)  # noqa: B023
            return ok

        end = _walk_one(x, visit)
        last = best(end, 0)
        has.append(last is not None)
        path, k = [], last[2] if last else 0
        while k:
            path.append(k)
            k = back[k]
        path = np.array(path[::-1], dtype=np.int64)
        for o, v in zip(cols, (np.full(len(path), len(has) - 1), *(c[path] for c in (x.start, x.end, x.rank, x.word, x.left, x.right, x.cost)), np.array([total[k] for k in path.tolist()], dtype=np.int64))):
            o.append(v)
    return np.array(has, dtype=bool), *(np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)


def pair_counts(ix: Index, texts: list[str], most_run: int = 0, ignore_space: bool = False, begin: np.ndarray | None = None, whole: np.ndarray | None = None, weight: np.ndarray | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """left and right: (ids, how many adjacent pairs of reachable nodes have them on that side) in non-empty sentences, no cost asked.

    A place passes its reachability on to the ends of the words that start there; then
    words that end and words that start at a place make all pairs.  Texts that are not ``whole`` to
    their sentence's end have no pairs with it; each counts ``weight`` times.
    """
    x = lattice(ix, texts, most_run, ignore_space, begin)
    many, spots = x.many, int(x.size.sum()) + x.many
    closed = np.arange(many) if whole is None else np.flatnonzero(whole)
    weight = np.ones(many, dtype=np.int64) if weight is None else weight
    reached = np.zeros(spots, dtype=bool)
    reached[x.spot(np.arange(many), 0)] = True
    begins = np.full(len(x.who), -1)  # where a word hangs: before the spaces that it skips

    def visit(nodes, t):
        at = x.spot(x.who[nodes], t)
        ok = reached[at]
        live = nodes[ok]
        begins[live] = at[ok]
        reached[x.spot(x.who[live], x.end[live])] = True
        return ok

    closing = x.spot(closed, _walk(x, visit)[closed])
    used = np.flatnonzero(begins >= 0)
    stops = x.spot(x.who[used], x.end[used])
    ending = np.bincount(np.concatenate((x.spot(np.arange(many), 0), stops)), minlength=spots)
    starting = np.bincount(np.concatenate((closing, begins[used])), minlength=spots)
    out = {}
    for side, ids, who, count in (
        ("left", np.concatenate((np.zeros(len(closed), np.int64), x.left[used])), np.concatenate((closed, x.who[used])), ending[np.concatenate((closing, begins[used]))]),
        ("right", np.concatenate((x.right[:many], x.right[used])), np.concatenate((np.arange(many), x.who[used])), starting[np.concatenate((x.spot(np.arange(many), 0), stops))]),
    ):
        sums = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
        np.add.at(sums, ids, count * weight[who])
        met = np.flatnonzero(sums)
        out[side] = met, sums[met]
    return out


def node_counts(ix: Index, texts: list[str], weight: np.ndarray, most_run: int = 0) -> list[np.ndarray]:
    """rank, word, characters, how many nodes have them, and the sum of their places among the nodes that end where they do; reached or not.

    Each text counts ``weight`` times.
    """
    x = lattice(ix, texts, most_run)
    many = x.many
    who, start, end, rank, word = (c[many:] for c in (x.who, x.start, x.end, x.rank, x.word))
    key = end * many + who
    order = _order(key, np.arange(len(key)))
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    n = end - start
    longest = int(n.max(initial=0)) + 1
    kinds, kind = np.unique((word * 3 + rank) * longest + n, return_inverse=True)
    count, places = np.zeros(len(kinds), dtype=np.int64), np.zeros(len(kinds), dtype=np.int64)
    np.add.at(count, kind, weight[who])
    np.add.at(places, kind, place * weight[who])
    return [kinds // longest % 3, kinds // longest // 3, kinds % longest, count, places]


def _pieces(count: np.ndarray):
    """Ranges of rows whose counts sum to PAIRS or little more."""
    upto, a = np.cumsum(count), 0
    while a < len(count):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        yield a, b
        a = b
