import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kumiki.operators import lattice as N
from kumiki.operators.batch import pair_counts
from kumiki.plans import fixture as X
from kumiki.plans import tokenizer as T
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L

PARTS = ["the", "tion", "auf", "idiot", "a", " ", "  ", " ", " ", ",", ", ", "And", "É", "ß", "12", "\t", " \t ", "\x0b", "#", "漢", "😀", "zzzz", "The IN"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    return ["", " ", "   ", "the", " the", "the ", "\t", "a\t b", None] + ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 30))) for _ in range(150)]


@pytest.fixture(scope="module")
def lines(spark, texts):
    return spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, sent_id long, text string")


@pytest.fixture(scope="module")
def plain(spark):
    return Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)


def counted(t, lines, texts):
    index, pairs = t.dictionary.compact().open(), Counter()
    for text in filter(None, texts):
        for side, (ids, many) in pair_counts(index, [text]).items():
            pairs.update({(side, i): n for i, n in zip(ids.tolist(), many.tolist())})
    want = t.transform(lines).groupBy("surface", "lex_type").agg(F.count("*"), F.min("word_cost"))
    assert sorted(map(tuple, t.surface_counts(lines).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(r.side, r.id): r.cnt for r in t.connid_counts(lines).collect()} == pairs


def test_pieces_count_what_whole_sentences_have(spark, plain, texts, lines):
    t = T.Tokenizer(plain)
    assert t._compact.value.fence is not None
    counted(t, lines, texts)


def test_sentences_stay_whole_where_words_run_over_spaces(spark, plain, texts, lines):
    t = T.Tokenizer(plain.with_user(L.from_text(spark, X.USER)))
    assert t._compact.value.fence is None
    counted(t, lines, texts)


def test_nodes_are_those_of_the_joins(spark, plain, lines):
    matches = N.prefix_matches(lines, plain.words())
    runs = N.groupable_runs(N.char_infos(N.char_positions(lines), plain.categories, plain.points))
    nodes = N.lattice_nodes(matches, N.unknown_candidates(runs, matches, plain.unknown))
    want = nodes.groupBy("lex_rank", "word_id", (F.col("end") - F.col("start")).alias("n")).agg(F.count("*"), F.sum("ix"))
    assert sorted(map(tuple, T.Tokenizer(plain).node_counts(lines).collect())) == sorted(map(tuple, want.collect()))


def test_equal_pieces_are_folded_once(spark, plain):
    t = T.Tokenizer(plain)
    some = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("sent_id"), F.concat_ws(" ", *[F.lit(w) for w in ("auf", "the", "the", "den", "auf")], F.col("id") % 5).alias("text"))
    pieces = t._pieces(some)[0].collect()
    assert {(r.piece, r.place): r.cnt for r in pieces} == {("auf ", 1): 2000, ("auf ", 0): 2000, ("the ", 0): 4000, ("den ", 0): 2000} | {(str(k), 2): 400 for k in range(5)}
