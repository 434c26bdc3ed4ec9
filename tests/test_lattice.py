import pytest
from pyspark.sql import functions as F

from kumiki.errors import InvalidArgument, InvalidFormat
from kumiki.functions.rewriting import Rewriter, Template
from kumiki.operators import connectors as C
from kumiki.operators import lattice as N
from kumiki.operators import viterbi as V
from kumiki.plans import fixture as X
from kumiki.plans import tokenizer as T
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L

CHAR = "DEFAULT 0 1 0\nSPACE 0 1 0\nLETTER 1 1 2\n0x0020 SPACE\n0x0061..0x007A LETTER\n"
UNK = "DEFAULT,0,0,900,D\nSPACE,0,0,10,S\nLETTER,1,1,500,L\n"
LEX = 'ab,1,1,10,A\nab,1,1,10,B\nabc,1,1,200,C\n"a,b",0,0,5,"quoted, tail"\nc,1,1,20,D\n'
MATRIX = "2 2\n0 1 3\n1 0 4\n1 1 -6\n1 1 -5\n"


@pytest.fixture(scope="module")
def small(spark):
    return Dictionary.from_lines(spark, LEX, CHAR, UNK, MATRIX)


def tokens(spark, d, text, **options):
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, sent_id long, text string")
    return T.Tokenizer(d, **options).transform(df).orderBy("token_pos").collect()


def test_last_of_equal_words_wins_and_costs_add_up(spark, small):
    got = tokens(spark, small, "abc")
    assert [(r.surface, r.word_id, r.total_cost) for r in got] == [("ab", 1, 13), ("c", 4, 28)]


def test_every_option_against_all_paths(spark, small):
    d = small.compact()

    def all_paths(text, ignore, most):
        best = None
        infos = [d.info(c) for c in text]
        run = V.runs([m for _, m in infos])
        space = 1 << d.names["SPACE"]

        def walk(node, right, cost, path):
            nonlocal best
            word = node + (run[node] if ignore and node < len(text) and infos[node][1] & space else 0)
            if word >= len(text):
                total = cost + d.cost[0][right]
                if best is None or total < best[0]:
                    best = total, path
                return
            for end, entries in V.candidates(d, text, word, infos[word][0], run[word], most):
                for e in entries:
                    walk(end, e[3], cost + d.cost[e[2]][right] + e[4], [*path, text[word:end]])

        walk(0, 0, 0, [])
        return best

    for text in ("abc", "ab ab", "  abc  c", "xyzab", "a,b é", "abcabc ab"):
        for ignore in (False, True):
            for most in (0, 1):
                ends, at, last = V.lattice(d, text, ignore, most)
                want = all_paths(text, ignore, most)
                assert (last is None) == (want is None)
                if last is not None:
                    node = ends[at][last]
                    assert node[4] + d.cost[0][node[2][3]] == want[0], (text, ignore, most)


def test_spaces_are_skipped_and_ends_attach_before_them(spark, small):
    a = [(r.surface, r.total_cost) for r in tokens(spark, small, "ab   c", ignore_space=True)]
    assert a == [(r.surface, r.total_cost) for r in tokens(spark, small, "  ab c ", ignore_space=True)]
    assert [x for x, _ in a] == ["ab", "c"]
    assert [(r.char_start, r.char_end) for r in tokens(spark, small, " ab", ignore_space=True)] == [(1, 3)]


def test_offsets_in_characters_and_bytes(spark, small):
    got = tokens(spark, small, "éab")
    assert [(r.surface, r.char_start, r.byte_start, r.byte_end) for r in got] == [("é", 0, 0, 2), ("ab", 1, 2, 4)]
    assert tokens(spark, small, "") == []


def test_a_dead_end_is_reported(spark):
    d = Dictionary.from_lines(spark, "ab,0,0,1,A", CHAR, "DEFAULT,0,0,1,D\nLETTER,0,0,9,L", "1 1\n")
    assert tokens(spark, d, "ab ")[0].surface is None
    with pytest.raises(Exception, match="no path"):
        tokens(spark, d, "ab ", strict=True)


def test_user_words_come_first_and_ids_are_checked(spark, small):
    d = small.with_user(L.from_text(spark, "abc,1,1,-500,U"))
    assert [(r.surface, r.lex_type) for r in tokens(spark, d, "abc")] == [("abc", "User")]
    assert d.with_user(None).user is None
    with pytest.raises(InvalidArgument):
        small.with_user(L.from_text(spark, "abc,9,1,-500,U"))


def test_fold_in_the_engine_agrees(spark):
    d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    s = spark.createDataFrame([(1, 0, "The tion, and 12 Lich"), (2, 0, "scum é auf"), (3, 0, "")], "doc_id long, sent_id long, text string")
    m = N.prefix_matches(s, d.words())
    runs = N.groupable_runs(N.char_infos(N.char_positions(s), d.categories, d.points))
    nodes = N.lattice_nodes(m, N.unknown_candidates(runs, m, d.unknown))
    fold = {(r.doc_id, p.start, p.end, p.lex_rank, p.word_id) for r in V.best_path_fold(nodes, s, d.compact().cost).collect() for p in r.path}
    rows = T.Tokenizer(d).transform(s).collect()
    assert fold == {(r.doc_id, r.char_start, r.char_end, V.RANKS.index(r.lex_type), r.word_id) for r in rows}
    edges = N.lattice_edges(N.reachable_nodes(nodes), s)
    assert sorted(map(tuple, N.connid_counts(edges).collect())) == sorted(map(tuple, T.Tokenizer(d).connid_counts(s).collect()))


def test_written_dictionary_reads_back(spark, small, tmp_path):
    small.write(str(tmp_path / "d"))
    d = Dictionary.read(spark, str(tmp_path / "d"))
    assert [r.surface for r in tokens(spark, d, "abc")] == ["ab", "c"]


def test_remapping_keeps_words_and_costs(spark, small):
    order = spark.createDataFrame([(1, 1)], "old_id int, new_id int")
    d = small.mapped(order, order)
    assert [(r.surface, r.total_cost) for r in tokens(spark, d, "abc ab")] == [(r.surface, r.total_cost) for r in tokens(spark, small, "abc ab")]
    with pytest.raises(InvalidArgument):
        C.permutation(spark.createDataFrame([(2, 1)], "old_id int, new_id int"), 2)


@pytest.mark.parametrize("text", ["a,1,1,0", "a,x,1,0,f", "a,70000,1,0,f"])
def test_bad_lexicon_lines(spark, text):
    with pytest.raises(InvalidFormat):
        L.lexicon(L.from_text(spark, text))


def test_lexicon_cells(spark):
    rows = L.lexicon(L.from_text(spark, '"a""b",1,2,-3,x,"y, z"\n\n,1,1,1,gone\nc,0,0,0,')).orderBy("word_id").collect()
    assert [tuple(r) for r in rows] == [(0, 'a"b', 1, 2, -3, 'x,"y, z"'), (1, "c", 0, 0, 0, "")]


@pytest.mark.parametrize("text", ["2", "2 2\n2 0 1", "2 2\n0 0", "2 2\n0 0 99999"])
def test_bad_matrices(spark, text):
    with pytest.raises(InvalidFormat):
        L.matrix(L.from_text(spark, text))


@pytest.mark.parametrize("text", ["A 0 0 0", "DEFAULT 0 1 0\n0x0041 B", "DEFAULT 0 1 0\n0x0042..0x0041 DEFAULT", "DEFAULT 2 1 0", "DEFAULT 0 1 0\n0x10000 DEFAULT"])
def test_bad_char_definitions(text):
    with pytest.raises(InvalidFormat):
        L.char_def(text.splitlines())


def test_corpus_and_split(spark):
    rows = L.tagged_corpus(L.from_text(spark, "a\tX\nb\tY\nEOS\nEOS\nc\tZ\nEOS\ntail\tW")).orderBy("example_id", "token_pos").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "a", "X"), (0, 1, "b", "Y"), (1, 0, "c", "Z")]
    parts = {r.part: r["count"] for r in T.corpus_split(spark.range(101), "id", 0.1, 0.25).groupBy("part").count().collect()}
    assert parts == {"valid": 10, "test": 25, "train": 66}


def test_rewriting_follows_the_tree():
    r = Rewriter([(["a", "x"], ["1"]), (["*", "*"], ["2"]), (["a", "*"], ["3", "$2", "$7"])])
    assert r(["a", "y"]) == ["3", "y", "*"] and r(["b", "y"]) == ["2"] and r(["a"]) is None
    with pytest.raises(InvalidArgument):
        Rewriter([(["a"], ["$0"])])
    assert Template("x%F[1]-%F?[0]-%t", "F")(["a", "*"], 3) == "x*-a-3" and Template("%L?[1]", "L")(["a"]) is None


def test_probabilities_count_id_zero(spark):
    counts = spark.createDataFrame([("left", 0, 1), ("left", 1, 5), ("left", 2, 4)], "side string, id int, cnt long")
    rows = N.connid_probs(counts, 3, 1).where("side = 'left'").orderBy("rank").collect()
    assert [(r.id, r.prob) for r in rows] == [(1, 0.5), (2, 0.4)]


def test_streams_give_the_same_tokens(spark, small, tmp_path):
    from kumiki.streaming.tokens import stream_tokens

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc\nab ab\n")
    q = stream_tokens(spark.readStream.text(str(tmp_path / "in")), T.Tokenizer(small)).writeStream.format("memory").queryName("toks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert sorted(r.surface for r in spark.table("toks").collect()) == [" ", "ab", "ab", "ab", "c"]
    assert F.lit(1) is not None


def test_side_by_side_fold_equals_the_single_one(spark):
    import random

    import numpy as np

    from kumiki.operators.batch import Index, best_paths

    r = random.Random(4)
    texts = ["".join(r.choice(["the", "tion", " ", "And", "é", "ß", "12", ",", "😀", "q", "\t"]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    gaps = Dictionary.from_lines(spark, "the,0,0,1,A\ntion,0,0,1,A", X.CHAR, "ALPHA,0,0,9,L\nDIGIT,0,0,1,D", "1 1\n")  # not every sentence has a path
    for dictionary in (d, d.with_user(L.from_text(spark, X.USER)), gaps):
        c = dictionary.compact()
        for most in (0, 2):
            got, want = best_paths(Index(c), texts, most), V._one_by_one(c, texts, range(len(texts)), False, most)
            assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert not got[0].all() and got[0].any()
    groups, alone = V._alike(texts + [""] + ["x" * 5000])
    assert sorted([i for g in groups for i in g] + alone) == [*range(len(texts)), len(texts) + 1] and len(texts) + 1 in alone
