import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kumiki.operators import batch as B
from kumiki.plans import fixture as X
from kumiki.plans import tokenizer as T
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L

BITS = ["the", "tion", " ", " ", "And", "é", "12", ",", "\t", "😀", "een", "onth"]


@pytest.mark.parametrize("ignore", [True, False])
def test_totals_equal_those_of_the_tokens(spark, ignore):
    d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    r = random.Random(8)
    rows = [(k % 70, "".join(r.choice([*BITS, "\n"]) for _ in range(r.randrange(60)))) for k in range(90)] + [(90, None), (91, ""), (92, " \n "), (None, "the x")]
    lines = L.sentences(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    t = T.Tokenizer(d, ignore_space=ignore)
    want = t.transform(lines).groupBy("doc_id").agg(F.count("token_pos").alias("n_tokens"), F.max("total_cost").alias("most"))
    assert sorted(map(str, t.totals(lines).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("ignore", [True, False])
def test_cheapest_by_right_id_are_the_cheapest_of_all(spark, ignore, monkeypatch):
    # few costs, so that most choices are between equally cheap neighbours
    matrix = "10 10\n" + "\n".join(f"{a} {b} {(a * b) % 2}" for a in range(10) for b in range(10))
    lexicon = "\n".join(f"{w},{k % 3 + 1},{k % 4 + 1},{k % 2},N" for k, w in enumerate(["a", "b", "ab", "ba", "aba", "a", "ab", "bab"]))
    r = random.Random(4)
    texts = ["".join(r.choice("aabb b é1") for _ in range(r.randrange(1, 40))) for _ in range(200)]
    ix = Dictionary.from_lines(spark, lexicon, X.CHAR, X.UNKNOWN, matrix).compact().open()
    assert B._by_right(ix, B.lattice(ix, texts, 0, ignore)) is not None
    got = B.best_paths(ix, texts, 0, ignore)
    single = B.one_by_one(ix, texts, 0, ignore)
    monkeypatch.setattr(B, "DENSE", 0)
    assert B._by_right(ix, B.lattice(ix, texts, 0, ignore)) is None
    for a, b, c in zip(got, B.best_paths(ix, texts, 0, ignore), single):
        assert np.array_equal(a, b) and np.array_equal(a, c)


def test_numbers_beyond_64_bits_are_not_packed(spark):
    ix = Dictionary.from_lines(spark, "a,1,1,32767,N\nb,1,1,-32768,N", X.CHAR, X.UNKNOWN, X.MATRIX).compact().open()
    x = B.lattice(ix, ["ab" * 100] * 24)
    assert B._by_right(ix, x) is not None
    x.cost[-1] = 1 << 45
    assert B._by_right(ix, x) is None
