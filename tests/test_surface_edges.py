import random

from pyspark.sql import functions as F

from kumiki.operators import alignment as A
from kumiki.operators import lattice as N
from kumiki.plans.dictionary import Dictionary
from kumiki.sources import lines as L

CHAR = "DEFAULT 0 1 0\nLETTER 1 0 2\nDIGIT 1 1 0\n0x0061..0x007A LETTER\n0x0030..0x0039 DIGIT LETTER\n"
LEX = "ab,0,0,0,N,x\na,0,0,0,V,y\nb,0,0,0,V,z\nbc,0,0,0,N,w\nc,0,0,0,P,c\nabc,0,0,0,N,x\nab,0,0,0,\"q,1\",w\nab,0,0,0,V,y\n"
UNK = "DEFAULT,0,0,0,U,*\nLETTER,0,0,0,*,y,k\nLETTER,0,0,0,U,*\nDIGIT,0,0,0,*,*,*\n"


def test_edges_by_surface_are_all_edges(spark):
    r = random.Random(6)
    tags = ["N,x", "V,y", "V,z", "P,c", "U,d", "Q", '"q,1",w', "V,y,k"]
    text = "\n".join(x for _ in range(60) for x in [*(r.choice(["ab", "a", "b", "bc", "c", "abc", "12", "é", "zz"]) + "\t" + r.choice(tags) for _ in range(r.randint(1, 5))), "EOS"])
    d = Dictionary.from_lines(spark, LEX, CHAR, UNK, "1 1\n")
    corpus = L.tagged_corpus(L.from_text(spark, text))
    sentences, runs = A.sentence_runs(corpus, d.categories, d.points)
    gold = A.gold_edges(corpus, d.lexicon, d.unknown, runs)
    matches = N.prefix_matches(sentences, d.lexicon.withColumn("lex_rank", F.lit(N.SYSTEM)))
    want = A.training_edges(gold, matches, N.unknown_candidates(runs, matches, d.unknown)).collect()
    got = A.surface_edges(gold, sentences, runs, d.lexicon, d.unknown).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(x.gold and x.kind == A.WORD for x in got)
