import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kumiki.operators import batch as B
from kumiki.operators import stretches as S
from kumiki.operators import viterbi as V
from kumiki.plans import fixture as X
from kumiki.plans.dictionary import Dictionary
from kumiki.plans.tokenizer import evened
from kumiki.sources import lines as L

PARTS = ["the", "tion", "auf", "idiot", "a", " ", "  ", " ", " ", ",", ", ", ".", "And", "É", "ß", "12", "\t", " \t ", "\x0b", "#", "漢", "😀", "zzzz", "The IN", "xqj"]


def totals(fold, ix, texts, *options):
    has, who, *_, cost = fold(ix, texts, *options)
    count, most = np.bincount(who, minlength=len(texts)), np.full(len(texts), -(1 << 60))
    np.maximum.at(most, who, cost)
    return has, count, np.where(count > 0, most, 0)


def same(ix, texts, *, ignore, most_run=0):
    for got, want in zip(S.Stretches.of(ix, ignore).totals(texts, most_run), totals(B.best_paths, ix, texts, most_run, ignore)):
        assert np.array_equal(got, want)


@pytest.fixture(scope="module")
def plain(spark):
    return Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX).compact()


@pytest.fixture
def small(monkeypatch):
    """Many slices, folds and rows of few characters."""
    for name, value in {"CHARACTERS": 4000, "HELD": 900, "ROWS": 40, "FEWEST": 3, "WHOLE": 24, "ROW": 16, "BEFORE": 12}.items():
        monkeypatch.setattr(S, name, value)


@pytest.mark.parametrize("ignore", [True, False])
@pytest.mark.parametrize("most_run", [0, 2])
def test_totals_are_those_of_whole_sentences(plain, small, ignore, most_run):
    r = random.Random(21)
    texts = [" ", "   ", "the", " the ", "\t", "a\t b", "😀", "漢 漢"] + ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    texts += ["the " * 200, "Und " * 150, "zz" * 300, " ".join(r.choice(PARTS) for _ in range(900))]
    same(plain.open(), texts, ignore=ignore, most_run=most_run)


@pytest.mark.parametrize("ignore", [True, False])
def test_equally_cheap_paths_fall_as_in_whole_sentences(spark, small, ignore):
    matrix = "10 10\n" + "\n".join(f"{a} {b} {(a * b) % 2}" for a in range(10) for b in range(10))
    lexicon = "\n".join(f"{w},{k % 3 + 1},{k % 4 + 1},{k % 2},N" for k, w in enumerate(["a", "b", "ab", "ba", "aba", "a", "ab", "bab"]))
    ix = Dictionary.from_lines(spark, lexicon, X.CHAR, X.UNKNOWN, matrix).compact().open()
    r = random.Random(6)
    same(ix, ["".join(r.choice("aabb b é1,") for _ in range(r.randrange(1, 90))) for _ in range(300)], ignore=ignore)


def test_a_sentence_without_a_path_has_no_tokens(spark, small):
    unknown = "\n".join(x for x in X.UNKNOWN.splitlines() if not x.startswith(("DIGIT", "DEFAULT")))
    ix = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, unknown, X.MATRIX).compact().open()
    r = random.Random(2)
    texts = ["the 1", "1 the", "漢", "the , 1 , the", "the " * 40 + "1"] + ["".join(r.choice([*PARTS, "the "]) for _ in range(r.randrange(1, 40))) for _ in range(200)]
    has, count, _ = S.Stretches.of(ix, True).totals(texts)
    assert not has[:5].any() and not count[:5].any() and has.any()
    for ignore in (True, False):
        same(ix, texts, ignore=ignore)


def test_rows_that_stay_apart_are_not_taken(plain, monkeypatch):
    # after a short beginning the costs of such lines may depend on all of them: these are folded by themselves, to the same result
    for name, value in {"WHOLE": 8, "ROW": 4, "BEFORE": 1}.items():
        monkeypatch.setattr(S, name, value)
    alone = []
    monkeypatch.setattr(S, "one_by_one", lambda ix, texts, *rest: alone.extend(texts) or B.one_by_one(ix, texts, *rest))
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "und", "tion", "heit", "za", "Und"]) for _ in range(60)) for _ in range(60)]
    same(plain.open(), texts, ignore=True)
    assert alone


def test_words_that_leave_their_run_keep_whole_sentences(spark, plain):
    user = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX).with_user(L.from_text(spark, X.USER)).compact().open()
    assert S.Stretches.of(user, True) is None
    r = random.Random(5)
    same(user, ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 40))) for _ in range(100)], ignore=False)
    shared = Dictionary.from_lines(spark, X.LEXICON, X.CHAR.replace("0x0009..0x000D SPACE", "0x0009..0x000D SPACE PUNCT"), X.UNKNOWN, X.MATRIX).compact().open()
    assert S.Stretches.of(shared, True) is None


def test_documents_are_not_folded_node_by_node(plain, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(r.choice(["the", "Und", "tion", "heitza", "12,", "auf."]) for _ in range(r.randrange(1, 200))) for _ in range(400)] + ["", None]
    want = totals(B.best_paths, plain.open(), texts[:-2], 0, True)

    class Sent:
        value = plain

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(V, "best_paths", never)
    monkeypatch.setattr(V, "one_by_one", never)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = {d: (n, m) for b in V.total_batches(Sent, True)([rows]) for d, n, m in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {k: (n, m) for k, (n, m) in enumerate(zip(want[1].tolist(), want[2].tolist()))}


def test_rows_of_one_large_row_group_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(4000).selectExpr("id doc_id", "concat(repeat(md5(string(id)), 60), '\n', id) text").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 14))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        table = spark.read.parquet(str(tmp_path / "one"))
        cores = spark.sparkContext.defaultParallelism
        assert table.rdd.getNumPartitions() >= cores
        dealt = [r["count"] for r in evened(table).groupBy(F.spark_partition_id()).count().collect()]
        assert max(dealt) * cores <= 2 * 4000 and sum(dealt) == 4000
        assert sorted(evened(table).collect()) == sorted(table.collect())
        few = table.coalesce(1)
        assert evened(few) is few
        even = table.repartition(2 * cores)
        assert evened(even) is even
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
