import random

import numpy as np
import pytest

from kumiki.operators import connectors as C
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L
from kumiki.train import merge
from kumiki.train.crf import FeatureSet, Model

CHAR = "DEFAULT 0 1 0\nLETTER 1 0 2\n0x0061..0x007A LETTER\n"
LEX = "ab,0,0,0,N,x\na,0,0,0,V,y\nb,0,0,0,V,z\n\"b,c\",0,0,0,N,w\nc,0,0,0,P,c\né,0,0,0,N,x\ncc,0,0,0,P\n"
UNK = "DEFAULT,0,0,0,U,*\nLETTER,0,0,0,U,*\n"
USER = "abc,0,0,0,N,new\nbb,3,2,-9,V,y\nca,0,0,0,P,c\n"


def lines(df):
    return "\n".join(r.value for r in df.orderBy("line_no").collect())


@pytest.mark.parametrize("pruned", [False, True])
def test_merged_lines_equal_the_models(spark, tmp_path, pruned):
    d = Dictionary.from_lines(spark, LEX, CHAR, UNK, "1 1\n")
    f = FeatureSet(["U:%F[0]", "W:%F[0]/%F?[1]", "C:%t"], [("%L[0]", "%R[0]"), ("%L?[1]", "%R?[1]")])
    m = Model(d, f)
    r = np.random.default_rng(7)
    m.w = np.where(r.random(len(m.w)) < 0.5, 0.0, r.standard_normal(len(m.w)))
    path = str(tmp_path / "model")
    m.write(path)
    if pruned:
        m.prune()
    else:
        m.add_user(L.from_text(spark, USER))
    got = merge.merged(spark, path, None if pruned else L.from_text(spark, USER), pruned)
    want, have = m.export(), merge.definition_lines(got)
    assert {k: lines(v) for k, v in have.items()} == want
    want, have = m.export_bigrams(), merge.bigram_lines(got)
    assert lines(have["right"]) == want["right"] and lines(have["left"]) == want["left"]
    assert sorted(lines(have["cost"]).split("\n")) == sorted(want["cost"].split("\n"))


def greedy(rights, lefts, raw):
    """Template by template: drop the one without which the fewest distinct rows are left, ties the highest."""
    rest, out = sorted({k for row in [*rights.values(), *lefts.values()] for k in row}), []
    for _ in range(raw):
        size = lambda rows, k: len({tuple(row.get(j) for j in rest if j != k) for row in rows.values()})  # noqa: E731, B023
        out.append(min(rest, key=lambda k: (size(rights, k) * size(lefts, k), -k)))
        rest.remove(out[-1])
    return sorted(out)


def test_template_reduction_equals_the_greedy_search(spark):
    for seed in range(3):
        r = random.Random(seed)
        sides = [{i: {k: f"{k % 3}:{r.randrange(1 + k)}" for k in range(11) if r.random() < 0.9} for i in range(40)} for _ in range(2)]
        frames = [spark.createDataFrame([(i, k, v) for i, row in rows.items() for k, v in row.items()], "id int, k int, feat string") for rows in sides]
        assert C.split_templates(*frames) == greedy(*sides, C.DUAL_RAW)
