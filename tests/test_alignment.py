import random

from kumiki.functions.table import register_tokenize
from kumiki.operators import alignment as A
from kumiki.operators import lattice as N
from kumiki.plans import fixture as X
from kumiki.plans import tokenizer as T
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L
from kumiki.train.crf import FeatureSet, Model

CHAR = "DEFAULT 0 1 0\nLETTER 1 0 2\nDIGIT 1 1 0\n0x0061..0x007A LETTER\n0x0030..0x0039 DIGIT LETTER\n"
LEX = "ab,0,0,0,N,x\na,0,0,0,V,y\nb,0,0,0,V,z\nbc,0,0,0,N,w\nc,0,0,0,P,c\nabc,0,0,0,N,x\nab,0,0,0,\"q,1\",w\n"
UNK = "DEFAULT,0,0,0,U,*\nLETTER,0,0,0,*,y,k\nLETTER,0,0,0,U,*\nDIGIT,0,0,0,*,*,*\n"


def corpus_text():
    r = random.Random(3)
    tags = ["N,x", "V,y", "V,z", "N,w", "P,c", "U,d", "Q", '"q,1",w', "V,y,k"]
    out = []
    for _ in range(80):
        out += [r.choice(["ab", "a", "b", "bc", "c", "abc", "12", "é", "zz", "d"]) + "\t" + r.choice(tags) for _ in range(r.randint(1, 5))] + ["EOS"]
    return "\n".join(out)


def test_edges_equal_the_trainers(spark):
    d = Dictionary.from_lines(spark, LEX, CHAR, UNK, "1 1\n")
    corpus = L.tagged_corpus(L.from_text(spark, corpus_text()))
    sentences, runs = A.sentence_runs(corpus, d.categories, d.points)
    gold = A.gold_edges(corpus, d.lexicon, d.unknown, runs)
    matches = N.prefix_matches(sentences, d.lexicon.withColumn("lex_rank", F.lit(N.SYSTEM)))
    edges = A.training_edges(gold, matches, N.unknown_candidates(runs, matches, d.unknown)).collect()
    model = Model(d, FeatureSet(["U:%F[0]"], [("%L[0]", "%R[0]")]))
    name = lambda k: (A.VIRTUAL, None) if k < 0 else ({1: A.WORD, 2: A.UNKNOWN}[model.labels[k][0]], model.labels[k][1])
    tokens, want = {}, set()
    for r in corpus.orderBy("example_id", "token_pos").collect():
        tokens.setdefault(r.example_id, []).append((r.surface, r.feature))
    for k, some in tokens.items():
        _, every, right = model.example(some)
        want |= {(k, a, b, *name(label), (a, b, label) in right) for a, b, label in every}
    assert {(r.example_id, r.start, r.end, r.kind, r.id, r.gold) for r in edges} == want
    assert len(edges) == len(want) and {r.kind for r in edges if r.gold} == {A.WORD, A.UNKNOWN, A.VIRTUAL}
    # words of one feature and first character share the last one's label
    assert any(r.gold and r.kind == A.WORD and r.id == 5 and r.end - r.start == 2 for r in edges)


def test_a_table_function_gives_the_tokenizers_tokens(spark):
    d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    r = random.Random(5)
    rows = [(k, "".join(r.choice(["the", "tion", " ", "And", "é", "12", ",", "\n", "😀"]) for _ in range(r.randrange(40)))) for k in range(60)] + [(90, None), (91, ""), (92, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.createOrReplaceTempView("some_documents")
    for options in ({}, {"ignore_space": True}):
        t = T.Tokenizer(d, **options)
        register_tokenize(spark, t, "tokens_of")
        columns = ["doc_id", "sent_id", "token_pos", "surface", "char_start", "char_end", "lex_type", "word_id", "left_id", "right_id", "word_cost", "total_cost"]
        got = spark.sql("SELECT d.doc_id, t.* FROM some_documents d, LATERAL tokens_of(d.text) t").select(columns)
        want = t.transform(L.sentences(docs, "doc_id")).where("surface IS NOT NULL").select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_numbers_rise_without_gaps(spark):
    r = random.Random(2)
    ids = [r.randrange(-(1 << 60), 1 << 60) for _ in range(3000)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = sorted((x.n, x.id) for x in N.numbered(rows, "id", "n").collect())
    assert got == list(enumerate(sorted(ids)))
    assert N.numbered(rows.limit(0), "id", "n").count() == 0 and N.numbered(rows.limit(1), "id", "n").first().n == 0


def test_unknown_ids_and_postings(spark):
    words = spark.createDataFrame([(0, "a", 1, 1), (1, "a", 9, 1), (2, "b", 1, 9), (3, "c", -1, 0)], "word_id long, surface string, left_id int, right_id int")
    assert sorted(r.word_id for r in N.unknown_ids(words, 9, 9).collect()) == [1, 2, 3]
    assert {r.surface: r.word_ids for r in N.postings(words).collect()} == {"a": [0, 1], "b": [2], "c": [3]}
