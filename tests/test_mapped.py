import random

import numpy as np
import pytest

from kumiki.errors import InvalidArgument
from kumiki.operators import viterbi as V
from kumiki.operators.batch import Index, best_paths, one_by_one, pair_counts
from kumiki.operators.pair_cost import PairCosts, pair_keys
from kumiki.plans import fixture as X
from kumiki.plans import mapped as M
from kumiki.plans import tokenizer as T
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L

BIGRAM = (X.BIGRAM_RIGHT, X.BIGRAM_LEFT, X.BIGRAM_COST)


def texts(n=200, longest=30, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(["the", "tion", " ", "  ", "And", "é", "ß", "12", ",", "😀", "q", "\t"]) for _ in range(r.randint(1, longest))) for _ in range(n)]


def rows(spark, d, some, **options):
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(some)], "doc_id long, sent_id long, text string")
    t = T.Tokenizer(d, **options)
    return sorted(map(tuple, t.transform(df).collect()), key=str), sorted(map(tuple, t.connid_counts(df).collect()))


def test_a_mapped_dictionary_gives_what_a_broadcast_one_does(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 7)  # many parts
    d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX).with_user(L.from_text(spark, X.USER))
    some = texts() + ["", "x" * 3000]
    for options in ({}, {"ignore_space": True, "max_grouping_len": 2}):
        assert rows(spark, d, some, mapped=True, **options) == rows(spark, d, some, mapped=False, **options)
    index = d.packed(mapped=True).open()
    assert isinstance(index.entries, np.memmap) or isinstance(index.entries.base, np.memmap)
    assert isinstance(index.cost, np.memmap) and index.cost.dtype == np.int16 and not index.cost.flags.writeable


def test_a_lexicon_of_many_words_and_no_limit(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 9))) for _ in range(20_000)})
    lexicon = "\n".join(f"{w},{i % 9 + 1},{i % 7 + 1},{r.randint(-300, 900)},F{i}" for i, w in enumerate(words + words[:50]))
    d = Dictionary.from_lines(spark, lexicon, X.CHAR, X.UNKNOWN, X.MATRIX)
    some = ["".join(r.choice(words + [" "]) for _ in range(r.randint(1, 9))) for _ in range(150)]
    assert rows(spark, d, some, mapped=True) == rows(spark, d, some, mapped=False)


@pytest.mark.parametrize("dual", [False, True])
def test_costs_summed_when_asked_equal_the_matrix(spark, dual):
    d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, bigram=BIGRAM, dual=dual)
    want = rows(spark, d, texts(60), mapped=False)
    assert rows(spark, d, texts(60), mapped=True, scorer=True) == want == rows(spark, d, texts(60), mapped=True, scorer=False)
    costs = {(r.left_id, r.right_id): r.cost for r in d.costs.collect()}
    left, right = (a.ravel() for a in np.indices((X.SIZE, X.SIZE)))
    index = d.packed(mapped=True, scorer=True).open()
    assert isinstance(index.cost, PairCosts) and index.conn(left, right).tolist() == [costs.get((a, b), 0) for a, b in zip(left, right)]
    plain = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    with pytest.raises(InvalidArgument):
        plain.packed(mapped=True, scorer=True)


def test_pair_costs_by_brute_force():
    r = np.random.default_rng(2)
    right, left = (np.where(r.random((30, 6)) < 0.2, 0, r.integers(1, 40, (30, 6))).astype(np.uint64) for _ in range(2))
    table = {(int(a), int(b)): int(c) for a, b, c in zip(r.integers(1, 40, 700), r.integers(1, 40, 700), r.integers(-40_000, 40_000, 700))}
    a, b = (np.array(x, dtype=np.uint64) for x in zip(*table))
    keys, cost = pair_keys(a, b), np.array(list(table.values()), dtype=np.int32)
    order = np.argsort(keys)
    assert len(set(keys.tolist())) == len(keys)
    for raw in (None, [True, False, True, False, False, True]):
        costs = PairCosts(right, left, keys[order], cost[order], raw)
        ids = r.integers(0, 30, (500, 2))
        part = lambda x, y, k: table.get((int(right[y, k]), int(left[x, k])), 0)
        own = [k for k in range(6) if raw is None or raw[k]]
        want = [sum(part(x, y, k) for k in own) + max(-32768, min(32767, sum(part(x, y, k) for k in range(6) if k not in own))) for x, y in ids.tolist()]
        assert costs.conn(ids[:, 0], ids[:, 1]).tolist() == want
    none = PairCosts(right, left, np.zeros(0, np.uint64), np.zeros(0, np.int32))
    assert none.conn(ids[:, 0], ids[:, 1]).tolist() == [0] * 500


def plain_counts(c, some, ignore, most):
    """Pairs of adjacent reachable nodes, sentence by sentence over the plain lattice."""
    out = {}

    def add(side, i):
        out[side, i] = out.get((side, i), 0) + 1

    for t in some:
        ends, at, _ = V.lattice(c, t, ignore, most)
        for node in [n for e in ends[1:] for n in e] + [(at, at, (0, 0, 0, 0, 0), 0, 0)]:
            for before in ends[node[0]]:
                add("left", node[2][2])
                add("right", before[2][3])
    return out


@pytest.mark.parametrize("ignore", [False, True])
@pytest.mark.parametrize("most", [0, 2])
def test_folds_and_counts_with_spaces_against_the_plain_lattice(spark, ignore, most):
    d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    # categories that overlap: runs of spaces that go on into other signs, words with spaces inside
    char = "DEFAULT 0 1 0\nSPACE 0 1 0\nMIX 1 1 2\nALPHA 1 0 2\n0x0020 SPACE\n0x002C MIX SPACE\n0x0061..0x007A ALPHA MIX\n"
    odd = Dictionary.from_lines(spark, "a b,1,1,5,A\n\" a\",2,2,3,B\nb ,1,2,9,C\na,2,1,1,D\n", char, "DEFAULT,1,1,90,D\nSPACE,2,2,7,S\nALPHA,1,2,50,L\nMIX,2,2,60,M\n", "3 3\n1 2 5\n2 1 -4\n2 2 3\n1 1 1\n0 1 2\n")
    gaps = Dictionary.from_lines(spark, "the,0,0,1,A\ntion,0,0,1,A", X.CHAR, "ALPHA,0,0,9,L\nDIGIT,0,0,1,D", "1 1\n")
    r = random.Random(most)
    strange = ["".join(r.choice("ab ,  é") for _ in range(r.randint(1, 14))) for _ in range(400)]
    for dictionary, some in ((d, texts()), (d.with_user(L.from_text(spark, X.USER)), texts(seed=9)), (gaps, texts()), (odd, strange)):
        c = dictionary.compact()
        want = V._one_by_one(c, some, range(len(some)), ignore, most)
        # the plain fold says where a word hangs, the others where it starts
        starts = []
        for t in some:
            ends, at, last = V.lattice(c, t, ignore, most)
            starts += [node[1] for _, node in V.path(ends, at, last)] if last is not None else []
        want = (*want[:2], np.array(starts, dtype=np.int64), *want[3:])
        for got in (best_paths(Index(c), some, most, ignore), one_by_one(Index(c), some, most, ignore)):
            assert all(np.array_equal(a, b) for a, b in zip(got, want))
        counts = {(side, i): n for side, (ids, many) in pair_counts(Index(c), some, most, ignore).items() for i, n in zip(ids.tolist(), many.tolist())}
        assert {k: n for k, n in counts.items() if n} == plain_counts(c, some, ignore, most)
