"""Totals of best paths over a small matrix: sentences are cut where one right id is left, and the stretches are folded side by side."""

from __future__ import annotations

import numpy as np

from .batch import DENSE, Index, one_by_one

_FAR = np.int64(1) << np.int64(62)
#: Characters that are looked at together, those folded together, rows folded together at most, and the fewest.
CHARACTERS, HELD, ROWS, FEWEST = 1 << 20, 1 << 20, 1 << 13, 24
#: Characters up to which a stretch is one row; of the rows of a longer one, and of what each is folded over before its own begin.
WHOLE, ROW, BEFORE = 192, 128, 40
#: Words, cells of a trie's table, characters of a word and words that begin one another at most.
WORDS, CELLS, LONGEST, CHAIN = 50_000, 1 << 22, 64, 32


class Stretches:
    """A dictionary's tables for ``totals``; entries are numbered by rank and number, ids by the few that entries have."""

    def __init__(self, ix: Index, ignore_space: bool):
        self.ix, self.ignore_space = ix, ignore_space
        entries = np.concatenate((ix.entries, ix.unknown)).astype(np.int64).reshape(-1, 5)
        order = np.lexsort((entries[:, 1], entries[:, 0]))
        entries, at = entries[order], np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        self.of_words = at[: len(ix.entries)]
        self.unknown = [at[len(ix.entries) + a : len(ix.entries) + a + n].tolist() for a, n in zip(ix.unk_at.tolist(), ix.unk_many.tolist())]
        (self.lefts, self.left), (self.rights, self.right) = (np.unique(entries[:, c], return_inverse=True) for c in (2, 3))
        self.cost, costs = entries[:, 4], ix.cost.astype(np.int64)
        #: Costs between them, from what a stretch begins with (no right id first, then those of ``rights``), and to a sentence's end.
        self.begins = np.append(0, self.rights)
        self.conn, self.begin, self.end = costs[np.ix_(self.lefts, self.rights)], costs[np.ix_(self.lefts, self.begins)], costs[0, self.rights]
        self.most = max(int(np.abs(self.cost).max(initial=0)), int(np.abs(costs).max()))
        #: For each category its unknown words: how many, and the first, second and so on, 0 without one.
        self.unknown_many = np.array([len(some) for some in self.unknown])
        self.unknown_next = [np.array([some[j] if j < len(some) else 0 for some in self.unknown]) for j in range(self.unknown_many.max(initial=0))]
        self.mask, self.base = ix.mask.astype(np.int32), ix.base.astype(np.int32)
        self.grouped = np.array(sorted({int(self.right[e]) for some, group in zip(self.unknown, ix.group.tolist()) if group for e in some}), dtype=np.int64)
        self.only = self._only()
        #: Lengths up to which words that do not reach to their run's end go.
        self.longest = max(1, int(ix.length.max(initial=0)), int(ix.size.max(initial=0)))
        self.ready = self.longest <= LONGEST and self._trie()
        self.kept = np.empty(0, dtype=np.int64)

    @classmethod
    def of(cls, ix: Index, ignore_space: bool) -> "Stretches | None":
        """None where the matrix or the lexicon is large, words are long, or, where spaces are ignored, spaces share a category or a word with others, or words leave their run."""
        if not isinstance(ix.cost, np.ndarray) or ix.cost.size > DENSE or len(ix.size) > WORDS or not len(ix.entries) + len(ix.unknown):
            return None
        if ignore_space and np.any((ix.mask & ix.space > 0) & (ix.mask != ix.space)):
            return None
        made = cls(ix, ignore_space)
        return made if made.ready and not (ignore_space and made.only is None) else None

    def _only(self) -> np.ndarray | None:
        """By character: the right id of all words that start at it, -1 where they have several; None where a word leaves a run of characters that share categories.

        Words that start with an ignored space are in no path.
        """
        ix = self.ix
        low, high = np.full(len(ix.mask), len(self.rights)), np.full(len(ix.mask), -1)
        for k, some in enumerate(self.unknown):
            if some:
                low[ix.base == k], high[ix.base == k] = min(self.right[some]), max(self.right[some])
        if len(ix.size):
            masks = ix.mask[np.where(ix.text < 65536, ix.text, 0)]
            apart = np.append((masks[1:] & masks[:-1]) == 0, False)
            apart[ix.first + ix.size - 1] = False  # the next character is another word's
            if self.ignore_space:
                apart &= ~np.repeat((masks[ix.first] & ix.space) > 0, ix.size)
            if apart.any():
                return None
            first = np.repeat(ix.text[ix.first], ix.many)
            first = np.where(first < 65536, first, 0)
            np.minimum.at(low, first, self.right[self.of_words])
            np.maximum.at(high, first, self.right[self.of_words])
        return np.where(low == high, low, -1).astype(np.int32)

    def _trie(self) -> bool:
        """Characters' classes (0: in no word), the trie's next nodes, and each node's last word; for each word its entries with those of the words that begin it."""
        ix = self.ix
        letters = np.unique(ix.text)
        nodes: list[dict[int, int]] = [{}]
        word, chain = [-1], []
        classes = np.searchsorted(letters, ix.text) + 1
        for w, (a, n, at, many) in enumerate(zip(ix.first.tolist(), ix.size.tolist(), ix.at.tolist(), ix.many.tolist())):
            node, before = 0, -1  # shorter words come first
            for c in classes[a : a + n].tolist():
                before = word[node] if word[node] >= 0 else before
                if c not in nodes[node]:
                    nodes[node][c] = len(nodes)
                    nodes.append({})
                    word.append(-1)
                node = nodes[node][c]
            word[node] = w
            chain.append((chain[before] if before >= 0 else []) + [(n, e) for e in self.of_words[at : at + many].tolist()])
            if len(chain[-1]) > CHAIN or len(nodes) * (len(letters) + 1) > CELLS:
                return False
        self.letters, self.width = letters, len(letters) + 1
        self.next = np.zeros((len(nodes), self.width), dtype=np.int32)
        for k, some in enumerate(nodes):
            for c, to in some.items():
                self.next[k, c] = to
        self.word, self.leaf = np.array(word, dtype=np.int32), np.array([not some for some in nodes])
        self.many = np.array([len(c) for c in chain], dtype=np.int64)
        self.chain = [(np.array([c[j][0] if j < len(c) else 0 for c in chain], dtype=np.int64), np.array([c[j][1] if j < len(c) else 0 for c in chain], dtype=np.int64)) for j in range(max(map(len, chain), default=0))]
        self.classes = np.zeros(65536, dtype=np.int32)
        self.classes[letters[letters < 65536]] = np.flatnonzero(letters < 65536) + 1
        return True

    def _longest(self, cps: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest word that starts at each character, -1 without one; none goes on behind a ``stop``."""
        classes = self.classes[np.minimum(cps, 65535)]
        beyond = np.flatnonzero(cps > 65534)
        if len(beyond):
            k = np.minimum(np.searchsorted(self.letters, cps[beyond]), max(len(self.letters) - 1, 0))
            classes[beyond] = np.where(self.letters[k] == cps[beyond], k + 1, 0) if len(self.letters) else 0
        node = self.next[0][classes]
        out = self.word[node]
        out[node == 0] = -1
        at = np.flatnonzero((node > 0) & ~stop & ~self.leaf[node])
        node, table = node[at], self.next.reshape(-1)
        for n in range(1, self.longest):
            if not len(at):
                break
            node = table[node * self.width + classes[at + n]]
            on = node > 0
            at, node = at[on], node[on]
            word = self.word[node]
            got = word >= 0
            out[at[got]] = word[got]
            on = ~stop[at + n] & ~self.leaf[node]
            at, node = at[on], node[on]
        return out

    def totals(self, texts: list[str], most_run: int = 0):
        """(has a path, tokens, the largest total cost up to one) of sentences; without tokens the last is 0."""
        parts, a, met, many = [], 0, 0, sum(map(len, texts))
        each = many / max(1, round(many / CHARACTERS))
        for b, text in enumerate(texts, 1):
            met += len(text)
            if met >= each or b == len(texts):
                parts.append(self._some(texts[a:b], most_run))
                a, met = b, 0
        return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in (bool, np.int64, np.int64)]

    def _some(self, texts: list[str], most_run: int):
        ix = self.ix
        has, count, most = np.ones(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sent = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        known = np.where(cps < 65536, cps, 0)
        mask = self.mask[known]
        cut = np.ones(len(cps), dtype=bool)  # whether a run ends behind a character
        cut[:-1] = ((mask[:-1] & mask[1:]) == 0) | (sent[:-1] != sent[1:])
        place = None
        if self.ignore_space:  # spaces end runs, and nothing else comes of them
            place = np.flatnonzero((mask & ix.space) == 0)
            cps, sent, known, cut = cps[place], sent[place], known[place], cut[place]
        if not len(cps):
            return has, count, most
        ends = np.flatnonzero(cut)
        begins = np.append(0, ends[:-1] + 1)
        room = np.repeat((ends + 1).astype(np.int32), ends - begins + 1) - np.arange(len(cps), dtype=np.int32)  # characters up to the run's end
        last = np.append(sent[1:] != sent[:-1], True)
        # stretches end with their sentence, or behind a run all of whose words have one right id
        behind, only = last.copy(), None
        if self.only is not None:
            only = self.only[known]
            low = np.minimum.reduceat(only, begins)
            behind[ends[(low >= 0) & (low == np.maximum.reduceat(only, begins))]] = True
        stop = np.flatnonzero(behind)
        x = _Some()
        x.begin, x.size, x.closing = np.append(0, stop[:-1] + 1), np.diff(np.append(-1, stop)), last[stop]
        x.exit = only[stop] if only is not None else np.zeros(len(stop), dtype=np.int32)
        x.entry = np.where(np.append(True, x.closing[:-1]), 0, np.append(0, x.exit[:-1] + 1))
        x.word = self._longest(cps, cut if only is not None else last)
        # unknown words: lengths 1 to ``fixed``, and the run
        matched, base = x.word >= 0, self.base[known]
        group, use = ix.group[base] > 0, ~matched | (ix.invoke[base] > 0)
        whole = use & group & ~((most_run > 0) & (room - 1 > most_run))
        fixed = np.minimum(ix.length.astype(np.int32)[base], room)
        fixed -= group & (fixed == room)
        fixed[~use] = 0
        fixed[use & ~matched & ~whole & (fixed < 1)] = 1
        x.kind = ((base * (self.longest + 1) + fixed) * 4 + whole * 2 + cut).astype(np.int32)

        # rows: stretches, or the parts of long ones
        of_run = np.searchsorted(stop, ends)
        upto = ends + 1 - x.begin[of_run]
        inner = (x.size[of_run] > WHOLE) & (upto < x.size[of_run]) & (upto // ROW != np.append(0, upto[:-1]) // ROW) & (only is not None)
        start = np.sort(np.append(x.begin, ends[inner] + 1))
        x.of = np.searchsorted(stop, start)
        x.until, x.follows = np.append(start[1:], len(cps)), start != x.begin[x.of]
        early = begins[np.maximum(np.searchsorted(begins, start - BEFORE, side="right") - 1, 0)]
        x.start, x.own = np.where(x.follows, np.maximum(early, x.begin[x.of]), start), start
        x.first = np.flatnonzero(~x.follows)
        length, parts = x.until - x.start, np.diff(np.append(x.first, len(start)))
        largest = np.maximum.reduceat(length, x.first)

        reached, tokens, high, total = np.zeros(len(x.size), dtype=bool), *(np.zeros(len(x.size), dtype=np.int64) for _ in range(3))
        order = np.argsort(-largest, kind="stable")
        most_of, few = largest[order], 0
        while few < len(order) and most_of[few] > 2 * most_of[min(few + FEWEST, len(order) - 1)] + 2 * WHOLE:
            few += 1
        alone, order = [order[:few]], order[few:]
        order = np.concatenate((order[parts[order] > 1], order[parts[order] == 1]))
        some, upto = np.cumsum(parts[order]), np.cumsum(np.add.reduceat(length, x.first)[order])
        at, most_rows = 0, max(FEWEST, min(ROWS, HELD // (self.longest + 1)))
        while at < len(order):
            to = min(int(np.searchsorted(c, (c[at - 1] if at else 0) + n, side="right")) for c, n in ((some, most_rows), (upto, HELD)))
            k = order[at : max(at + 1, to)]
            reached[k], tokens[k], high[k], total[k], sure = self._fold(x, k, parts[k])
            alone.append(k[~sure])
            at += len(k)
        alone = np.concatenate(alone)
        off, known = np.cumsum(size) - size, {}
        for k in alone.tolist():
            a, b = int(x.begin[k]), int(x.begin[k] + x.size[k] - 1)
            s = int(sent[a])
            a, b = (int((place[c] if place is not None else c) - off[s]) for c in (a, b))  # with the spaces within it
            key = texts[s][a : b + 1], int(x.entry[k])
            if key not in known:
                path, who, *_, costs = one_by_one(ix, [key[0]], most_run, self.ignore_space, self.begins[[key[1]]])
                known[key] = (path[0], len(who), costs.max(), costs[-1]) if len(who) else (path[0], 0, 0, 0)
            reached[k], tokens[k], high[k], total[k] = known[key]

        # stretches of a sentence one behind the other
        who = sent[x.begin]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        before = np.cumsum(total) - total
        before -= np.repeat(before[first], np.diff(np.append(first, len(total))))
        who = who[first]
        has[who] = np.logical_and.reduceat(reached, first)
        count[who], most[who] = np.add.reduceat(tokens, first), np.maximum.reduceat(before + high, first)
        count[~has], most[~has] = 0, 0
        return has, count, most

    def _fold(self, x: "_Some", some: np.ndarray, parts: np.ndarray):
        """(has a path, tokens, the largest cost up to one, cost of all, whether these are sure) of stretches with so many rows each.

        A number holds a node's cost and, below it, what tells it from others that end with it: the later its start and
        the larger its rank and number, the smaller, so that the least number is the cheapest node and the last of equally cheap ones.
        They are not sure where numbers would pass 64 bits.  A row behind another is folded from some characters before it, as if
        they began a sentence; it is sure where the costs to its begin, by left id, differ from those that the row before it
        ends with by the same for all, as then all that follows is the same.
        """
        rows = np.repeat(x.first[some] - (np.cumsum(parts) - parts), parts) + np.arange(int(parts.sum()))
        of, order = np.repeat(np.arange(len(some)), parts), np.argsort(x.start[rows] - x.until[rows], kind="stable")
        where = np.empty(len(rows), dtype=np.int64)
        where[order] = np.arange(len(rows))
        rows, of, final = rows[order], of[order], where[np.cumsum(parts) - 1]
        before = np.where(x.follows[rows], where[np.maximum(order - 1, 0)], -1)
        begin, size, skip = x.start[rows], (x.until - x.start)[rows], (x.own - x.start)[rows]
        entry = np.where(begin == x.begin[x.of[rows]], x.entry[x.of[rows]], 0)
        many, lefts, rights = len(rows), len(self.lefts), len(self.rights)
        top, entries, shift = int(size[0]), len(self.cost), int(len(self.cost)).bit_length()
        bits = shift + (top + 1).bit_length()
        if 2 * self.most * (top + 2) >= 1 << (60 - bits):
            none = np.zeros(len(some), dtype=np.int64)
            return none > 0, none, none, none, none > 0
        low = (np.int64(1) << np.int64(bits)) - 1
        high = ~low
        conn, add = np.ascontiguousarray(self.conn.T) << bits, (self.cost << bits) | (entries - 1 - np.arange(entries))
        live = np.searchsorted(-size, -np.arange(top + 2), side="right")  # stretches that have a place
        # at each place: the least number, with the cost to it, of what ends there for each left id
        off = np.append(0, np.cumsum(live[1:-1]) * lefts)
        if len(self.kept) < off[-1]:
            self.kept = np.empty(max(int(off[-1]), HELD * lefts), dtype=np.int64)
        # at this place and the next ones: the least number for each right id
        ahead = np.full((self.longest + 1, rights, many), _FAR)
        flat, run = ahead.reshape(-1), np.full((len(self.grouped), many), _FAR)
        of_run, flat_run, to_run = {int(r): run[k] for k, r in enumerate(self.grouped)}, run.reshape(-1), np.zeros(rights, dtype=np.int64)
        to_run[self.grouped] = np.arange(len(run)) * many
        chain = [(n, self.left[e], self.right[e] * many, add[e]) for n, e in self.chain]
        spare, per = np.empty((lefts, many), dtype=np.int64), 4 * (self.longest + 1)
        last, kind = np.empty((rights, many), dtype=np.int64), None
        for t in range(top + 1):
            slots = [(t + m) % (self.longest + 1) for m in range(self.longest + 1)]
            here, n = ahead[slots[0]], int(live[t + 1])
            if t and len(run):
                ended = np.flatnonzero(kind & 1)
                if len(ended):
                    for r, k in zip(self.grouped.tolist(), run):
                        here[r, ended] = np.minimum(here[r, ended], k[ended])
                        k[ended] = _FAR
            last[:, n : live[t]] = here[:, n : live[t]]
            if not n:
                break
            least, other = self.kept[off[t] : off[t] + lefts * n].reshape(lefts, n), spare[:, :n]
            if t:
                np.add(here[0, :n], conn[0][:, None], out=least)
                for r in range(1, rights):
                    np.add(here[r, :n], conn[r][:, None], out=other)
                    np.minimum(least, other, out=least)
                here[:, :n] = _FAR
            else:
                least[:] = (self.begin[:, entry] << bits) | low
            late = (top - t) << shift
            at = begin[:n] + t
            kind, word = x.kind[at], x.word[at]
            slot, costs = np.array(slots) * (rights * many), least.reshape(-1)
            # unknown words of a category that most have; of the others
            rest = np.ones(n, dtype=bool)
            for k, words in enumerate(self.unknown):
                mine = (kind >= k * per) & (kind < (k + 1) * per)
                if 4 * np.count_nonzero(mine) <= n:
                    continue
                rest &= ~mine
                whole, which = mine & (kind & 2 > 0), []
                while words and len(which) < self.longest and (w := (kind >= k * per + 4 * (len(which) + 1)) & mine).any():
                    which.append(w)
                for e in words:
                    value, r = (least[self.left[e]] & high) + (add[e] + late), self.right[e]
                    for m, w in enumerate(which, 1):
                        into = ahead[slots[m], r, :n]
                        np.minimum(into, np.where(w, value, _FAR), out=into)
                    if r in of_run:
                        into = of_run[r][:n]
                        np.minimum(into, np.where(whole, value, _FAR), out=into)
            row = np.flatnonzero(rest)
            base, fixed = np.divmod(kind[row], per)
            whole, fixed = fixed & 2 > 0, fixed >> 2
            for j, e in enumerate(self.unknown_next):
                more = np.flatnonzero(self.unknown_many[base] > j)
                if not len(more):
                    break
                if len(more) < len(row):
                    row, base, fixed, whole = row[more], base[more], fixed[more], whole[more]
                e = e[base]
                value, right = (costs[self.left[e] * n + row] & high) + (add[e] + late), self.right[e] * many + row
                for m in range(1, int(fixed.max()) + 1):
                    which = np.flatnonzero(fixed >= m)
                    cell = slot[m] + right[which]
                    flat[cell] = np.minimum(flat[cell], value[which])
                which = np.flatnonzero(whole)
                cell = to_run[right[which] // many] + row[which]
                flat_run[cell] = np.minimum(flat_run[cell], value[which])
            row = np.flatnonzero(word >= 0)
            word = word[row]
            for j, (m, left, right, cost) in enumerate(chain):
                if j:
                    more = self.many[word] > j
                    row, word = row[more], word[more]
                if not len(row):
                    break
                cell = slot[m[word]] + right[word] + row
                flat[cell] = np.minimum(flat[cell], (costs[left[word] * n + row] & high) + (cost[word] + late))
        # costs of a row above what its stretch's first begins with
        sure, added = np.ones(len(some), dtype=bool), np.zeros(many, dtype=np.int64)
        later = np.flatnonzero(before >= 0)
        if len(later):
            own = self.kept[off[skip[later]] + np.arange(lefts)[:, None] * live[skip[later] + 1] + later]
            left = np.min(last[:, before[later]][:, None, :] + conn[:, :, None], axis=0)
            same = (own < _FAR >> 1).all(axis=0) & (left < _FAR >> 1).all(axis=0)
            above = (left >> bits) - (own >> bits)
            same &= (above == above[0]).all(axis=0)
            sure[of[later[~same]]] = False
            added[later] = above[0]
            in_order = added[where]
            upto = np.cumsum(in_order)
            first = np.cumsum(parts) - parts
            added = (upto - np.repeat(upto[first] - in_order[first], parts))[order]
        # the last node, then from node to node
        ends = last[:, final]
        pick = np.where(x.closing[some], np.argmin(ends + (self.end << bits)[:, None], axis=0), x.exit[some])
        node, row = ends[pick, np.arange(len(some))], final
        has = node < _FAR >> 1
        total = np.where(has, (node >> bits) + added[row], 0)
        count, most, who = np.zeros(len(some), dtype=np.int64), total.copy(), np.flatnonzero(has & sure)
        node, row, cost = node[who], row[who], total[who]
        while len(who):
            count[who] += 1
            most[who] = np.maximum(most[who], cost)
            start, e = top - ((node & low) >> shift), entries - 1 - (node & ((1 << shift) - 1))
            on = start > 0
            who, row, start, left = who[on], row[on], start[on], self.left[e[on]]
            back = np.flatnonzero((start == skip[row]) & (before[row] >= 0))
            node = self.kept[off[start] + left * live[start + 1] + row]
            node_cost = (node >> bits) - self.conn[left, self.right[entries - 1 - (node & ((1 << shift) - 1))]]
            if len(back):
                row[back] = before[row[back]]
                ends = last[:, row[back]]
                pick = np.argmin(ends + conn[:, left[back]], axis=0)
                node[back] = ends[pick, np.arange(len(back))]
                node_cost[back] = node[back] >> bits
            cost = node_cost + added[row]
        return has, count, most, total, sure


class _Some:
    """Stretches of some sentences, and what is known of their characters."""
