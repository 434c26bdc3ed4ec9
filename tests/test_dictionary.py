import random

import pytest
from pyspark.sql import functions as F

from kumiki import scripts
from kumiki.errors import InvalidArgument, InvalidFormat
from kumiki.plans import dictionary as D
from kumiki.plans import fixture as X
from kumiki.plans import tokenizer as T
from kumiki.sources import lines as L

TEXTS = ["the tion And 12 of, la", "Überlick ing  der", "a", "scum idiot é É", ""]


def sentences(spark):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS)], "doc_id long, sent_id long, text string")


def tokens(spark, d):
    return [tuple(r) for r in T.Tokenizer(d).transform(sentences(spark)).select("sent_id", "token_pos", "surface", "lex_type", "word_id", "total_cost").orderBy("sent_id", "token_pos").collect()]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("def")
    for name in ("LEXICON", "CHAR", "UNKNOWN", "MATRIX", "USER", "BIGRAM_RIGHT", "BIGRAM_LEFT", "BIGRAM_COST"):
        (folder / name).write_text(getattr(X, name))
    return folder


def test_paths_give_what_lines_give(spark, files):
    path = lambda name: str(files / name)
    lines = D.Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    paths = D.Dictionary.from_paths(spark, path("LEXICON"), path("CHAR"), path("UNKNOWN"), path("MATRIX"))
    for name in ("lexicon", "categories", "points", "unknown", "costs"):
        assert sorted(map(tuple, getattr(lines, name).collect())) == sorted(map(tuple, getattr(paths, name).collect()))
    assert tokens(spark, lines) == tokens(spark, paths)
    with pytest.raises(InvalidArgument):
        D.Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN)


def test_line_numbers_rise_over_the_splits_of_a_file(spark, tmp_path):
    want = [f"line {i} " + "é" * (i % 40) for i in range(3000)] + ["", "last"]
    (tmp_path / "f").write_text("\n".join(want))
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert [r.value for r in L.from_path(spark, str(tmp_path / "f")).orderBy("line_no").collect()] == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("dual", [False, True])
def test_factored_costs_equal_the_matrix(spark, monkeypatch, dual, tmp_path):
    d = D.Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, bigram=(X.BIGRAM_RIGHT, X.BIGRAM_LEFT, X.BIGRAM_COST), dual=dual)
    left = spark.createDataFrame([(X.SIZE - k, k) for k in range(1, X.SIZE)], "old_id int, new_id int")
    right = spark.createDataFrame([(k % (X.SIZE - 1) + 1, k) for k in range(1, X.SIZE)], "old_id int, new_id int")
    want, mapped = tokens(spark, d), d.mapped(left, right)
    mapped.write(str(tmp_path / "d"))
    monkeypatch.setattr(D, "MATRIX_CELLS", 10)
    monkeypatch.setattr(D, "HELD_ROWS", 2)
    assert isinstance(d.compact().cost, D.Factored)
    assert tokens(spark, d) == tokens(spark, mapped) == tokens(spark, D.Dictionary.read(spark, str(tmp_path / "d"))) == want
    with pytest.raises(InvalidArgument):
        D.Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX).compact()


def test_a_read_dictionary_still_maps_user_words(spark, tmp_path):
    d = D.Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
    left = spark.createDataFrame([(X.SIZE - k, k) for k in range(1, X.SIZE)], "old_id int, new_id int")
    right = spark.createDataFrame([(k % (X.SIZE - 1) + 1, k) for k in range(1, X.SIZE)], "old_id int, new_id int")
    d.mapped(left, right).write(str(tmp_path / "d"))
    user = L.from_text(spark, "tion,3,4,-9000,USER,Z\n")
    want = tokens(spark, d.with_user(user))
    again = D.Dictionary.read(spark, str(tmp_path / "d"))
    assert tokens(spark, again.with_user(user)) == want != tokens(spark, d)
    assert tokens(spark, again.with_user(user).with_user(None)) == tokens(spark, d)


def test_quoted_cells(spark):
    r = random.Random(1)
    rows = [",".join(L.quote_cell("".join(r.choice('ab",\n é*') for _ in range(r.randrange(5)))) for _ in range(r.randint(1, 5))) for _ in range(200)] + ["", ",", '""', "a,,b"]
    rows = [x for x in rows if "\n" not in x]
    got = spark.createDataFrame([(x,) for x in rows], "v string").select("v", L.cells(F.col("v")).alias("c"), T.picked(F.col("v"), [1, 0, 9]).alias("p")).collect()
    for x in got:
        cells = L.csv_row(x.v)
        assert x.c == cells
        assert L.csv_row(x.p) == [cells[1] if len(cells) > 1 else "*", cells[0], "*"]


def test_scraped_rows(spark):
    lines = L.from_text(spark, ['"a,b",1,2,3,N,*,c,*,5,6,7,8,9,yomi', "x,1,2,3,*,*,*,*,5,6,7,8,9,*", "y,1,2,3,V"])
    assert [r.value for r in L.scraped(lines).orderBy("line_no").collect()] == ['"a,b",1,2,3,N-c,yomi', "x,1,2,3,,", "y,1,2,3,V,"]


def test_external_text_model(spark):
    features = ["# templates", "UNIGRAM U:%F[0]", "BIGRAM A:%L[0]/B:%R[0]", "BIGRAM C:%L?[1]/D:%R[1]"]
    right = L.from_text(spark, ["0 BOS/EOS,*", "1 N,x", '2 V,"y,z"', "3 N,*"])
    left = L.from_text(spark, ["0 BOS/EOS,*", "1 N,p", "2 Q,q"])
    model = L.from_text(spark, ["header", "0.5\tA:N/B:Q", "-0.25\tC:y,z/D:p", "0.001\tA:V/B:N", "2\tA:N/B:unseen", "1.5\tBOS/EOS/B:N", "1\tU:N"])
    rights, lefts, costs = L.text_model(spark, features, right, left, model, 100.0)
    rf, lf, pair = L.bigram_features(L.from_text(spark, rights)), L.bigram_features(L.from_text(spark, lefts)), L.bigram_costs(costs)
    from kumiki.operators import connectors as C

    got = {(r.right_id, r.left_id): r.cost for r in C.summed(rf, lf, pair).collect()}
    assert got == {(1, 2): -50, (3, 2): -50, (2, 1): 25, (0, 1): -150}
    for bad in (["0 N,x"], ["0 BOS/EOS", "2 N"], ["nothing"]):
        with pytest.raises(InvalidFormat):
            L.text_model(spark, features, L.from_text(spark, bad), left, model, 1.0)


def test_scripts_from_files_to_scores(spark, files, tmp_path):
    path = lambda name: str(files / name)
    out = lambda name: str(tmp_path / name)
    read = lambda name: [r.value for r in L.from_path(spark, out(name) + "/part*").orderBy("line_no").collect()]
    (tmp_path / "text").write_text("\n".join(TEXTS[:4]))
    scripts.main(["compile", "--lexicon", path("LEXICON"), "--char", path("CHAR"), "--unknown", path("UNKNOWN"), "--matrix", path("MATRIX"), "--output", out("dic")])
    scripts.main(["tokenize", "--dictionary", out("dic"), "--input", out("text"), "--output", out("wakati"), "--mode", "wakati"])
    assert [x.replace(" ", "") for x in read("wakati")] == [x.replace(" ", "") for x in TEXTS[:4]]
    scripts.main(["reorder", "--dictionary", out("dic"), "--input", out("text"), "--output", out("order")])
    scripts.main(["map", "--dictionary", out("dic"), "--mapping", out("order"), "--output", out("mapped")])
    for name in ("dic", "mapped"):
        scripts.main(["tokenize", "--dictionary", out(name), "--input", out("text"), "--output", out(f"{name}-lines"), "--user-lexicon", path("USER")])
    assert read("dic-lines") == read("mapped-lines") and read("dic-lines").count("EOS") == 4
    (tmp_path / "corpus").write_text("the\tVERB\n \tSPACE\nof\tNOUN\nEOS\nla\tNOUN\nEOS\n" * 5)
    scripts.main(["evaluate", "--dictionary", out("dic"), "--corpus", out("corpus")])
    scripts.main(["benchmark", "--dictionary", out("dic"), "--input", out("text"), "--trials", "1", "--runs", "3"])
    scripts.main(["split", "--corpus", out("corpus"), "--output", out("parts"), "--valid", "0.2", "--test", "0.3"])
    assert [sum(x == "EOS" for x in read(f"parts/{p}")) for p in ("train", "valid", "test")] == [5, 2, 3]
    with pytest.raises(SystemExit):
        scripts.parser().parse_args(["split", "--corpus", "x", "--output", "y", "--valid", "1.5"])


def test_scripts_train_and_generate(spark, tmp_path):
    out = lambda name: str(tmp_path / name)
    for name, text in {"lex": "ab,0,0,0,N,x\na,0,0,0,V,y\nb,0,0,0,V,z\nbc,0,0,0,N,w\nc,0,0,0,P,c\n", "char": "DEFAULT 0 1 0\nLETTER 1 0 2\n0x0061..0x007A LETTER\n", "unk": "DEFAULT,0,0,0,U,*\nLETTER,0,0,0,U,*\n", "features": "UNIGRAM U:%F[0]\nUNIGRAM W:%F[0]-%F?[1]\nBIGRAM %L[0]/%R[0]\nBIGRAM %L?[1]/%R?[1]\n", "corpus": "ab\tN,x\nc\tP,c\nEOS\na\tV,y\nbc\tN,w\nEOS\n", "user": "abc,0,0,0,N,x\nca,1,1,-7,N,new\n", "rewrite": "[unigram rewrite]\nP,* P,$2\n"}.items():
        (tmp_path / name).write_text(text)
    scripts.main(["train", "--lexicon", out("lex"), "--char", out("char"), "--unknown", out("unk"), "--features", out("features"), "--rewrite", out("rewrite"), "--corpus", out("corpus"), "--output", out("model"), "--max-iter", "15"])
    scripts.main(["dictgen", "--model", out("model"), "--output", out("gen"), "--user-lexicon", out("user"), "--bigram"])
    g = {n: "\n".join(r.value for r in L.from_path(spark, out(f"gen/{n}") + "/part*").orderBy("line_no").collect()) for n in ("lexicon", "unknown", "matrix", "user", "bigram.right", "bigram.left", "bigram.cost")}
    user = [L.csv_row(x) for x in g["user"].splitlines()]
    own = next(L.csv_row(x) for x in g["lexicon"].splitlines() if x.startswith("ab,"))
    assert user[0][1:4] == own[1:4] and user[1] == ["ca", "1", "1", "-7", "N", "new"]  # the same features, the same ids and cost; rows with an id stay
    char = (tmp_path / "char").read_text()
    dense = D.Dictionary.from_lines(spark, g["lexicon"], char, g["unknown"], g["matrix"])
    lines = spark.createDataFrame([(0, 0, "abc"), (0, 1, "abcab")], "doc_id long, sent_id long, text string")
    words = lambda d: sorted(map(tuple, T.Tokenizer(d).transform(lines).select("sent_id", "token_pos", "surface").collect()))
    factored = D.Dictionary.from_lines(spark, g["lexicon"], char, g["unknown"], bigram=(g["bigram.right"], g["bigram.left"], g["bigram.cost"]))
    assert words(dense) == words(factored)
    cells = lambda d: {(r.right_id, r.left_id): r.cost for r in d.costs.collect()}
    a, b = cells(dense), cells(factored)
    assert all(abs(a.get(k, 0) - b.get(k, 0)) <= 2 for k in a.keys() | b.keys() if k != (0, 0))


def test_the_parts_of_a_file_are_read_in_order(spark, tmp_path):
    lines = [f"line {k}" * (k % 3 + 1) for k in range(500)]
    scripts._lines(L.from_text(spark, lines).repartition(6), str(tmp_path / "parts"))
    spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "line_no long, value string").repartitionByRange(5, "line_no").sortWithinPartitions("line_no").select("value").write.text(str(tmp_path / "five"))
    for name in ("parts", "five"):
        assert [r.value for r in L.from_path(spark, str(tmp_path / name)).orderBy("line_no").collect()] == lines


def test_a_small_dictionary_from_an_external_model(spark, tmp_path):
    out = lambda name: str(tmp_path / name)
    files = {
        "features": "BIGRAM %L[0]/%R[0]\nBIGRAM %L?[1]/y%R[0]\n", "right": "0 BOS/EOS,*\n1 N,x\n2 V,y\n", "left": "0 BOS/EOS,*\n1 N\n2 V\n",
        "model": "0.5\tN/V\n-0.25\tV/N\n1.5\tBOS/EOS/N\n0.1\tx/yV\n9\tnever/seen\n", "lex": "ab,1,1,10,N\na,2,2,5,V\nb,1,2,7,N\n", "char": "DEFAULT 0 1 0\n", "unk": "DEFAULT,1,1,99,U\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    scripts.main(["smalldic", "--features", out("features"), "--right", out("right"), "--left", out("left"), "--model", out("model"), "--lexicon", out("lex"), "--char", out("char"), "--unknown", out("unk"), "--factor", "100", "--output", out("dic")])
    d = D.Dictionary.read(spark, out("dic"))
    assert {(r.right_id, r.left_id): r.cost for r in d.costs.collect() if r.cost} == {(1, 2): -60, (2, 1): 25, (0, 1): -150}
    lines = spark.createDataFrame([(0, 0, "ab"), (0, 1, "aab")], "doc_id long, sent_id long, text string")
    for scorer in (False, True):
        got = T.Tokenizer(d, mapped=True, scorer=scorer).transform(lines).orderBy("sent_id", "token_pos").collect()
        assert [(r.sent_id, r.surface) for r in got] == [(0, "ab"), (1, "a"), (1, "ab")] and got[0].total_cost == 10 - 150
