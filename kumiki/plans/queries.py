"""Queries of the lattice tokenizer over the driver's tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rewriting import Rewriter, Template
from ..functions.table import register_tokenize
from ..operators import alignment as A
from ..operators import connectors as C
from ..operators import lattice as N
from ..operators import viterbi as V
from ..shipping import ship
from ..sources import lines as L
from . import fixture as X
from . import tokenizer as T
from .dictionary import Dictionary

_MADE: dict[tuple[str, str], Dictionary] = {}


def dictionary(spark: SparkSession, user: bool = False) -> Dictionary:
    key = spark.sparkContext.applicationId, str(user)
    if key not in _MADE:
        d = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, X.MATRIX)
        _MADE[key] = d.with_user(L.from_text(spark, X.USER)) if user else d
    return _MADE[key]


def _lines(spark: SparkSession, sf_dir: str, table: str = "benchmark", key: str = "item_id") -> DataFrame:
    return L.sentences(T.evened(ship(spark).read.parquet(f"{sf_dir}/{table}.parquet").select(key, "text")), key)


def _runs(spark, sf_dir):
    d = dictionary(spark)
    return N.groupable_runs(N.char_infos(N.char_positions(_lines(spark, sf_dir)), d.categories, d.points))


def _matches(spark, sf_dir, user=False):
    return N.prefix_matches(_lines(spark, sf_dir), dictionary(spark, user).words())


def _nodes(spark, sf_dir):
    m = _matches(spark, sf_dir)
    return N.lattice_nodes(m, N.unknown_candidates(_runs(spark, sf_dir), m, dictionary(spark).unknown))


def char_positions(spark, sf_dir):
    return N.char_positions(_lines(spark, sf_dir))


def char_categories(spark, sf_dir):
    d = dictionary(spark)
    return N.char_infos(N.char_positions(_lines(spark, sf_dir)), d.categories, d.points).select(*N.SENT, "pos", "cp", "base_id", "cate_mask", "invoke", F.col("group").alias("grp"), "length")


def char_info_packed(spark, sf_dir):
    d = dictionary(spark)
    rows = N.char_infos(N.char_positions(_lines(spark, sf_dir)), d.categories, d.points).select("ch", N.packed_info().alias("packed")).distinct()
    return rows.select("ch", "packed", *[c.alias("grp") if k == 3 else c for k, c in enumerate(N.unpacked_info(F.col("packed")))])


def groupable_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select(*N.SENT, "pos", "groupable")


def prefix_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


def unknown_candidates(spark, sf_dir):
    return N.unknown_candidates(_runs(spark, sf_dir), _matches(spark, sf_dir), dictionary(spark).unknown)


def lattice_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


def lattice_reachable(spark, sf_dir):
    return N.reachable_nodes(_nodes(spark, sf_dir)).groupBy(*N.SENT).agg(F.count("*").alias("n_nodes"), F.sum("ix").alias("ix_sum"))


def lattice_edges(spark, sf_dir):
    return N.lattice_edges(N.reachable_nodes(_nodes(spark, sf_dir)), _lines(spark, sf_dir)).groupBy("right_id", "left_id").agg(F.count("*").alias("cnt"))


def connection_cost_matrix(spark, sf_dir):
    return C.matrix_cost(lattice_edges(spark, sf_dir), dictionary(spark).costs)


def _bigrams(spark):
    t = lambda x: L.from_text(spark, x)
    return L.bigram_features(t(X.BIGRAM_RIGHT)), L.bigram_features(t(X.BIGRAM_LEFT)), L.bigram_costs(t(X.BIGRAM_COST))


def connection_cost_raw(spark, sf_dir):
    return C.raw_cost(lattice_edges(spark, sf_dir).select("right_id", "left_id"), *_bigrams(spark))


def bigram_dictionary(spark: SparkSession) -> Dictionary:
    key = spark.sparkContext.applicationId, "bigram"
    if key not in _MADE:
        _MADE[key] = Dictionary.from_lines(spark, X.LEXICON, X.CHAR, X.UNKNOWN, bigram=(X.BIGRAM_RIGHT, X.BIGRAM_LEFT, X.BIGRAM_COST))
    return _MADE[key]


def connection_cost_scorer(spark, sf_dir):
    """The raw costs again, summed in tasks from the mapped feature pairs of the pairs of ids that are asked."""
    index = ship(spark).sparkContext.broadcast(bigram_dictionary(spark).packed(mapped=True, scorer=True))
    return C.scored_cost(lattice_edges(spark, sf_dir).select("right_id", "left_id"), index)


def tokens_scorer(spark, sf_dir):
    """Tokens by costs that are summed from feature pairs when the fold asks for them."""
    t = T.Tokenizer(bigram_dictionary(spark), mapped=True, scorer=True)
    return t.transform(_lines(spark, sf_dir)).select(*N.SENT, "token_pos", "surface", "lex_type", "word_id", "total_cost")


def tokens_mapped(spark, sf_dir):
    """Tokens by a dictionary whose arrays all workers of a machine map."""
    t = T.Tokenizer(dictionary(spark, True), mapped=True)
    return t.transform(_lines(spark, sf_dir)).select(*N.SENT, "token_pos", "surface", "lex_type", "word_id", "total_cost")


def connection_cost_dual(spark, sf_dir):
    right, left, pair = _bigrams(spark)
    return C.dual_cost(lattice_edges(spark, sf_dir).select("right_id", "left_id"), right, left, pair, C.split_templates(right, left))


def word_counts_documents(spark, sf_dir):
    """How often each lexicon word stands in the lines of all documents."""
    nodes = T.Tokenizer(dictionary(spark)).node_counts(_lines(spark, sf_dir, "documents", "doc_id"))
    return nodes.where(F.col("lex_rank") < N.UNKNOWN).groupBy("lex_rank", "word_id").agg(F.sum("cnt").alias("cnt"))


def lattice_counts_documents(spark, sf_dir):
    """Nodes of the lattices of all documents' lines by kind of word and length."""
    nodes = T.Tokenizer(dictionary(spark)).node_counts(_lines(spark, sf_dir, "documents", "doc_id"))
    return nodes.groupBy("lex_rank", "n_chars").agg(F.sum("cnt").alias("cnt"), F.sum("ix_sum").alias("ix_sum"))


def mapping_file(spark, sf_dir):
    """New ids by falling shares, written as the lines of mapping files and read back."""
    probs = N.connid_probs(connid_counts(spark, sf_dir), X.SIZE, X.SIZE)
    rows = [L.id_order(L.order_lines(probs, side)).select(F.lit(side).alias("side"), "old_id", "new_id") for side in ("left", "right")]
    return rows[0].unionAll(rows[1])


def lexicon_scraped(spark, sf_dir):
    """A small lexicon's lines from rows of 14 cells: parts' names, types as cells 4 to 7, brands as cell 13."""
    part = ship(spark).read.parquet(f"{sf_dir}/part.parquet")
    kind = F.split("p_type", " ")
    row = F.concat_ws(",", L.quoted(F.concat(F.lit('"'), "p_name", F.lit(', x"'))), F.lit("1,2,3"), F.get(kind, F.lit(0)), F.lit("*"), F.coalesce(F.get(kind, F.lit(1)), F.lit("*")), F.lit("*"), *[F.lit("_")] * 5, F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("*"))
    return L.scraped(part.select(F.col("p_partkey").alias("line_no"), row.alias("value")))


def _tokens(spark, sf_dir, user=False, table="benchmark", key="item_id", **options):
    return T.Tokenizer(dictionary(spark, user), **options).transform(_lines(spark, sf_dir, table, key))


def tokens_detail(spark, sf_dir):
    t = T.Tokenizer(dictionary(spark))
    return t.with_features(t.transform(_lines(spark, sf_dir)))


def best_path_fold(spark, sf_dir):
    """The higher-order fold over every line; one row a token."""
    d = dictionary(spark)
    rows = V.best_path_fold(_nodes(spark, sf_dir), _lines(spark, sf_dir), d.compact().cost)
    return rows.select(*N.SENT, F.col("cost").alias("path_cost"), F.posexplode("path").alias("token_pos", "p")).select(*N.SENT, "path_cost", F.col("token_pos").cast("long").alias("token_pos"), "p.start", "p.end", "p.lex_rank", "p.word_id")


def tokens_wakati(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return T.wakati(T.Tokenizer(dictionary(spark)).transform(lines), lines)


def tokens_lines(spark, sf_dir):
    lines, t = _lines(spark, sf_dir), T.Tokenizer(dictionary(spark))
    return T.lines_format(t.with_features(t.transform(lines)), lines, detail=True)


def tokens_user_lexicon(spark, sf_dir):
    return _tokens(spark, sf_dir, True).select(*N.SENT, "token_pos", "surface", "lex_type", "word_id", "total_cost")


def tokens_max_grouping(spark, sf_dir):
    return _tokens(spark, sf_dir, max_grouping_len=4).select(*N.SENT, "token_pos", "surface", "lex_type", "word_id", "total_cost")


def tokens_ignore_space(spark, sf_dir):
    return _tokens(spark, sf_dir, ignore_space=True).select(*N.SENT, "token_pos", "surface", "char_start", "char_end", "lex_type", "word_id", "total_cost")


def connid_counts_ignore_space(spark, sf_dir):
    return T.Tokenizer(dictionary(spark), ignore_space=True).connid_counts(_lines(spark, sf_dir))


def tokens_ignore_space_documents(spark, sf_dir):
    return T.Tokenizer(dictionary(spark), ignore_space=True).totals(_lines(spark, sf_dir, "documents", "doc_id"))


def tokens_documents(spark, sf_dir):
    """Counts of every surface over all document lines."""
    return T.Tokenizer(dictionary(spark)).surface_counts(_lines(spark, sf_dir, "documents", "doc_id"))


def tokens_conversations(spark, sf_dir):
    """Tokens of each role in all conversations."""
    rows = T.evened(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("k", F.col("conv_id") * 4096 + F.col("turn"))
    out = T.Tokenizer(dictionary(spark)).surface_counts(L.sentences(rows, "k"))
    return out.groupBy("lex_type", F.length("surface").alias("n_chars")).agg(F.sum("cnt").alias("cnt"))


def token_counts(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy(*N.SENT).agg(F.count("token_pos").alias("n_tokens"), F.max("total_cost").alias("last_cost"))


def connid_counts(spark, sf_dir):
    return T.Tokenizer(dictionary(spark)).connid_counts(_lines(spark, sf_dir))


def connid_counts_documents(spark, sf_dir):
    """Pairs of the reachable lattices of all documents' lines."""
    return T.Tokenizer(dictionary(spark)).connid_counts(_lines(spark, sf_dir, "documents", "doc_id"))


def connid_probs(spark, sf_dir):
    d = dictionary(spark)
    out = N.connid_probs(connid_counts(spark, sf_dir), d.num_left, d.num_right)
    return out.withColumn("prob", F.round("prob", 6))


def _orders(spark):
    left = spark.createDataFrame([(X.SIZE - k, k) for k in range(1, X.SIZE)], "old_id int, new_id int")
    right = spark.createDataFrame([(k % (X.SIZE - 1) + 1, k) for k in range(1, X.SIZE)], "old_id int, new_id int")
    return left, right


def connid_remap(spark, sf_dir):
    d = dictionary(spark).mapped(*_orders(spark))
    return d.lexicon.select(F.lit("lexicon").alias("part"), F.col("word_id").alias("k"), "left_id", "right_id", F.col("word_cost").alias("cost")).unionAll(d.unknown.select(F.lit("unknown"), "unk_id", "left_id", "right_id", "word_cost")).unionAll(d.costs.select(F.lit("matrix"), F.lit(0).cast("long"), "left_id", "right_id", "cost"))


def remap_invariance(spark, sf_dir):
    d = dictionary(spark).mapped(*_orders(spark))
    return T.Tokenizer(d).transform(_lines(spark, sf_dir)).select(*N.SENT, "token_pos", "surface", "word_id", "word_cost", "total_cost")


def homograph_postings(spark, sf_dir):
    return dictionary(spark).postings().select("surface", F.array_join(F.transform("word_ids", lambda x: x.cast("string")), ",").alias("word_ids"))


def dictionary_validation(spark, sf_dir):
    d = dictionary(spark, True)
    bad = lambda df: df.where((F.col("left_id") >= 7) | (F.col("right_id") >= 7)).agg(F.count("*").alias("bad"))
    return bad(d.lexicon).withColumn("part", F.lit("lexicon")).unionAll(bad(d.unknown).withColumn("part", F.lit("unknown"))).unionAll(bad(d.user).withColumn("part", F.lit("user")))


def _corpus(spark, sf_dir):
    part = ship(spark).read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.col("p_partkey").alias("example_id"), F.posexplode(F.split("p_name", " ")).alias("token_pos", "surface"), F.concat_ws(",", F.replace("p_type", F.lit(" "), F.lit(",")), "p_brand").alias("feature"))
    return rows.withColumn("token_pos", F.col("token_pos").cast("long"))


#: Unknown entries with tags, for a corpus whose features are the cells of p_type and p_brand.
TAGGED_UNKNOWN = """DEFAULT,0,0,0,*
SPACE,0,0,0,*
ALPHA,0,0,0,"PROMO",*,STEEL
ALPHA,0,0,0,STANDARD,*,*,*
ALPHA,0,0,0,*,BRUSHED
UPPER,0,0,0,*
"""


def _number(*columns) -> F.Column:
    """A number below 2^60 of the columns' values: the same wherever and in whatever order they are met."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("long")


def _part_lexicon(spark, sf_dir):
    """A lexicon of the words of part names with their features: three quarters of them, by digest."""
    rows = _corpus(spark, sf_dir).select("surface", "feature").distinct().where(F.substring(F.md5(F.concat_ws("|", "feature", "surface")), 1, 1) < "c")
    number = _number("surface", "feature")
    return rows.select(number.alias("word_id"), "surface", (number % 1200).cast("int").alias("left_id"), (number % 1100).cast("int").alias("right_id"), (number % 900).cast("int").alias("word_cost"), "feature")


def _gold(spark, sf_dir):
    d, corpus = dictionary(spark), _corpus(spark, sf_dir)
    sentences, runs = A.sentence_runs(corpus, d.categories, d.points)
    unknown = L.unknowns(L.from_text(spark, TAGGED_UNKNOWN), d.categories)
    lexicon = _part_lexicon(spark, sf_dir)
    return sentences, runs, unknown, lexicon, A.gold_edges(corpus, lexicon, unknown, runs)


def gold_alignment(spark, sf_dir):
    """The label of every token of the part names: a word, a compatible unknown entry, or none."""
    return _gold(spark, sf_dir)[-1]


def training_edges(spark, sf_dir):
    """All edges of the part names' lattices, right ones and others."""
    sentences, runs, unknown, lexicon, gold = _gold(spark, sf_dir)
    return A.surface_edges(gold, sentences, runs, lexicon, unknown)


def postings_parts(spark, sf_dir):
    """The word numbers of every surface of the part names' lexicon."""
    return N.postings(_part_lexicon(spark, sf_dir)).select("surface", F.array_join(F.transform("word_ids", lambda x: x.cast("string")), ",").alias("word_ids"))


def validation_parts(spark, sf_dir):
    """Words of the part names' lexicon whose connection ids a matrix of 1000 by 1050 has not, by feature."""
    return N.unknown_ids(_part_lexicon(spark, sf_dir), 1050, 1000).groupBy("feature").agg(F.count("*").alias("bad"), F.min("word_id").alias("least"))


def labels_parts(spark, sf_dir):
    """Labels of the part names' lexicon in order of words' numbers, then of the unknown entries."""
    d = dictionary(spark)
    return N.labels(_part_lexicon(spark, sf_dir), L.unknowns(L.from_text(spark, TAGGED_UNKNOWN), d.categories))


def tokens_lateral(spark, sf_dir):
    """The tokens of the benchmark's texts by a table function in SQL."""
    ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet").createOrReplaceTempView("lateral_benchmark")
    register_tokenize(spark, T.Tokenizer(dictionary(spark)), "kumiki_tokenize")
    return spark.sql("SELECT b.item_id AS doc_id, t.sent_id, t.token_pos, t.surface, t.char_start, t.char_end, t.lex_type, t.word_id, t.left_id, t.right_id, t.word_cost, t.total_cost FROM lateral_benchmark b, LATERAL kumiki_tokenize(b.text) t")


def corpus_sentences(spark, sf_dir):
    return T.corpus_sentences(_corpus(spark, sf_dir))


def corpus_lines(spark, sf_dir):
    return T.corpus_lines(_corpus(spark, sf_dir))


def corpus_split(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return T.corpus_split(docs, "doc_id", 0.1, 0.2, seed=7)


def eval_prf(spark, sf_dir):
    """Words at white space as gold, tokens as system, feature cell 0 of each."""
    gold = _lines(spark, sf_dir).where("text <> ''").select(*N.SENT, F.posexplode(F.split("text", " ")).alias("k", "w"))
    before = Window.partitionBy(*N.SENT).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    gold = gold.withColumn("char_start", F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0)).cast("long"))
    gold = gold.where("w <> ''").select(*N.SENT, "char_start", (F.col("char_start") + F.length("w")).alias("char_end"), F.lit("VERB").alias("features"))
    system = tokens_detail(spark, sf_dir).withColumn("features", T.picked(F.col("feature"), [0]))
    out = T.accuracy(gold, system)
    return out.select("gold", "system", "both", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


RULES = [(["STANDARD", "(ANODIZED|BRUSHED)"], ["std", "$3", "$9"]), (["*", "*", "STEEL"], ["$2", "iron"]), (["STANDARD", "*"], ["std", "$2"]), (["(PROMO|SMALL)"], ["$1", "x"])]
UNIGRAM, LEFT = ["U0:%F[0]", "U1:%F?[1]/%F[2]", "U2:%t-%F[7]", "U3:%F?[7]"], "B:%L[0]+%L?[3]"


def _on_features(df: DataFrame, f: Callable[[list[str]], tuple], columns: str) -> DataFrame:
    """``f`` on each distinct feature, in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        for batch in batches:
            rows = [(x, *f(L.csv_row(x))) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names) + 1)], names=["feature", *names])

    return df.select("feature").where("feature is not null").distinct().mapInArrow(run, f"feature string, {columns}")


def feature_rewrite(spark, sf_dir):
    rewrite = Rewriter(RULES)
    return _on_features(_corpus(spark, sf_dir), lambda cells: (",".join(rewrite(cells) or cells),), "rewritten string")


def feature_templates(spark, sf_dir):
    uni, left = [Template(u, "F") for u in UNIGRAM], Template(LEFT, "L")
    return _on_features(_corpus(spark, sf_dir), lambda cells: (*[u(cells, 2) for u in uni], left(cells)), "u0 string, u1 string, u2 string, u3 string, l0 string")


def label_table(spark, sf_dir):
    """Labels 1.. of lexicon words, then of unknown entries, with the first character of each word."""
    d = dictionary(spark)
    n = d.lexicon.count()
    words = d.lexicon.select((F.col("word_id") + 1).alias("label_id"), F.lit("word").alias("kind"), "feature", F.substring("surface", 1, 1).alias("first_char"))
    return words.unionAll(d.unknown.select((F.col("unk_id") + 1 + n).alias("label_id"), F.lit("unknown"), "feature", F.lit(None).cast("string")))


def weight_scaling(spark, sf_dir):
    """Costs of weights: scaled to 16 bits by the largest weight, whole part of the negative."""
    part = ship(spark).read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_retailprice") - 1400.0).alias("w"))
    most = part.agg(F.max(F.abs("w")).alias("most"))
    return part.join(F.broadcast(most)).select("p_partkey", (-F.col("w") * (32767.0 / F.col("most"))).cast("int").alias("cost"))


def bench_stats(spark, sf_dir):
    """Minimum, mean and maximum of what is left of given values (events of each type) when one smallest and one largest are dropped."""
    rows = ship(spark).read.parquet(f"{sf_dir}/events.parquet").where("value is not null").select("event_type", "value")
    ends = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n > 2")
    inner = rows.join(ends, "event_type").groupBy("event_type", "n", "total", "lo", "hi").agg(*[F.count_if(F.col("value") == F.col(c)).alias(f"n_{c}") for c in ("lo", "hi")], F.min(F.when(F.col("value") > F.col("lo"), F.col("value"))).alias("next_lo"), F.max(F.when(F.col("value") < F.col("hi"), F.col("value"))).alias("next_hi"))
    left = lambda c, equal: F.when((F.col(f"n_{c}") > 1) | equal, F.col(c)).otherwise(F.col(f"next_{c}"))
    equal = F.col("lo") == F.col("hi")
    out = inner.select("event_type", (F.col("n") - 2).alias("kept"), left("lo", equal).alias("least"), ((F.col("total") - F.col("lo") - F.col("hi")) / (F.col("n") - 2)).alias("mean"), left("hi", equal).alias("most"))
    return out.select("event_type", "kept", *[F.round(c, 6).alias(c) for c in ("least", "mean", "most")])


def text_model_costs(spark, sf_dir):
    """Costs of a weights file whose rows are the customers' balances and segments."""
    rows = ship(spark).read.parquet(f"{sf_dir}/customer.parquet")
    # the two digits nearest to the double itself; format_string would round its shortest decimal form once more
    lines = rows.select(F.concat(F.expr("format_number(c_acctbal / 1000, '0.00')"), F.lit("\t"), "c_mktsegment", F.lit("/"), "c_name").alias("value"))
    return L.text_model_costs(lines, 7.0)


_QUERIES = (gold_alignment, training_edges, postings_parts, validation_parts, labels_parts, tokens_lateral, char_positions, char_categories, char_info_packed, groupable_runs, prefix_matches, unknown_candidates, lattice_nodes, lattice_reachable, lattice_edges, connection_cost_matrix, connection_cost_raw, connection_cost_scorer, connection_cost_dual, tokens_scorer, tokens_mapped, connid_counts_ignore_space, tokens_ignore_space_documents, connid_counts_documents, tokens_detail, best_path_fold, tokens_wakati, tokens_lines, tokens_user_lexicon, tokens_max_grouping, tokens_ignore_space, tokens_documents, tokens_conversations, token_counts, connid_counts, connid_probs, connid_remap, remap_invariance, homograph_postings, dictionary_validation, corpus_sentences, corpus_lines, corpus_split, eval_prf, feature_rewrite, feature_templates, label_table, weight_scaling, bench_stats, text_model_costs, word_counts_documents, lattice_counts_documents, mapping_file, lexicon_scraped)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


# SQL ---------------------------------------------------------------------------------------------


def _q(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"


def _entries(text: str) -> list[tuple]:
    out = []
    for line in text.splitlines():
        m = re.match(f"^{L.CELL},{L.CELL},{L.CELL},{L.CELL},(.*)$", line)
        cells = [(m[2 * k + 1] or m[2 * k + 2] or "").replace('""', '"') for k in range(4)]
        out.append((cells[0], *map(int, cells[1:]), m[9]))
    return out


def _tables(user: bool = False) -> str:
    cats, ranges = L.char_def(X.CHAR.splitlines())
    ids, points = {c[0]: i for i, c in enumerate(cats)}, {}
    for lo, hi, names in ranges:
        for cp in range(lo, hi + 1):
            points[cp] = (ids[names[0]], sum(1 << ids[n] for n in names))
    lex = [(1, i, *e) for i, e in enumerate(_entries(X.LEXICON))] + ([(0, i, *e) for i, e in enumerate(_entries(X.USER))] if user else [])
    unk = sorted(((ids[e[0]], i, e) for i, e in enumerate(_entries(X.UNKNOWN))), key=lambda x: x[:2])
    cost = {}
    for line in X.MATRIX.splitlines()[1:]:
        r, le, c = map(int, line.split())
        cost[r, le] = c
    return ",\n".join([
        _values("lex", "lex_rank, word_id, surface, left_id, right_id, word_cost, feature", lex),
        _values("cats", "base_id, invoke, grp, length", [(i, *c[1:]) for i, c in enumerate(cats)]),
        _values("points", "cp, base_id, cate_mask", [(cp, *v) for cp, v in points.items()]),
        _values("unk", "unk_id, base_id, left_id, right_id, word_cost, feature", [(k, c, *e[1:]) for k, (c, _, e) in enumerate(unk)]),
        _values("cost", "right_id, left_id, cost", [(*k, v) for k, v in cost.items()]),
    ])


_DOCUMENT_LINES = "lines AS MATERIALIZED (SELECT doc_id, (i - 1)::BIGINT AS sent_id, s[i] AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i))"
_LINES = "lines AS (SELECT item_id AS doc_id, (i - 1)::BIGINT AS sent_id, s[i] AS text FROM (SELECT item_id, string_split(coalesce(text, ''), chr(10)) AS s FROM benchmark), unnest(range(1, len(s) + 1)) AS t(i))"


def _lattice(user: bool = False, most_run: int = 0) -> str:
    return f"""{_LINES}, {_tables(user)},
chars AS (SELECT doc_id, sent_id, p - 1 AS pos, substr(text, p, 1) AS ch, unicode(substr(text, p, 1))::BIGINT AS cp FROM lines, unnest(range(1, length(text) + 1)) AS t(p) WHERE text <> ''),
infos AS (SELECT c.*, coalesce(p.base_id, 0) AS base_id, coalesce(p.cate_mask, 1) AS cate_mask, k.invoke, k.grp, k.length
  FROM chars c LEFT JOIN points p ON p.cp = CASE WHEN c.cp < 65536 THEN c.cp ELSE 0 END JOIN cats k ON k.base_id = coalesce(p.base_id, 0)),
cuts AS (SELECT *, CASE WHEN coalesce((lead(cate_mask) OVER w & cate_mask) = 0, true) THEN pos END AS cut FROM infos WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
runs AS MATERIALIZED (SELECT *, min(cut) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos + 1 AS g FROM cuts),
matches AS MATERIALIZED (SELECT l.doc_id, l.sent_id, p AS start, p + n AS "end", x.lex_rank, x.word_id, x.left_id, x.right_id, x.word_cost
  FROM lines l, unnest(range(0, length(l.text))) AS t(p) JOIN (SELECT DISTINCT length(surface) AS n FROM lex) s ON p + s.n <= length(l.text) JOIN lex x ON x.surface = substr(l.text, p + 1, s.n)),
hits AS (SELECT DISTINCT doc_id, sent_id, start FROM matches),
tries AS (SELECT r.*, h.start IS NOT NULL AS matched FROM runs r LEFT JOIN hits h ON h.doc_id = r.doc_id AND h.sent_id = r.sent_id AND h.start = r.pos),
lens AS (SELECT *, CASE WHEN grp AND ({most_run} = 0 OR g - 1 <= {most_run}) THEN [g] ELSE []::BIGINT[] END || list_filter(range(1, least(length, g) + 1), lambda n: NOT (grp AND n = g)) AS ns FROM tries WHERE NOT matched OR invoke),
unks AS MATERIALIZED (SELECT l.doc_id, l.sent_id, l.pos AS start, l.pos + n AS "end", 2 AS lex_rank, u.unk_id AS word_id, u.left_id, u.right_id, u.word_cost
  FROM lens l, unnest(CASE WHEN len(ns) = 0 AND NOT matched THEN [1::BIGINT] ELSE ns END) AS t(n) JOIN unk u ON u.base_id = l.base_id),
nodes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id, "end" ORDER BY start, lex_rank, word_id) - 1 AS ix FROM (SELECT * FROM matches UNION ALL SELECT * FROM unks)),
reach AS (SELECT doc_id, sent_id, 0::BIGINT AS at FROM lines WHERE text <> '' UNION SELECT n.doc_id, n.sent_id, n."end" FROM reach r JOIN nodes n ON n.doc_id = r.doc_id AND n.sent_id = r.sent_id AND n.start = r.at),
live AS MATERIALIZED (SELECT n.* FROM nodes n JOIN reach r ON r.doc_id = n.doc_id AND r.sent_id = n.sent_id AND r.at = n.start),
edges AS (SELECT a.right_id, b.left_id FROM (SELECT doc_id, sent_id, "end" AS at, right_id FROM live UNION ALL SELECT doc_id, sent_id, 0, 0 FROM lines WHERE text <> '') a
  JOIN (SELECT doc_id, sent_id, start AS at, left_id FROM live UNION ALL SELECT doc_id, sent_id, length(text), 0 FROM lines WHERE text <> '') b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.at = b.at)"""


_PATH = """,
dp AS (SELECT doc_id, sent_id, length(text) AS n, 0::BIGINT AS step, 0::BIGINT AS e, 0::BIGINT AS ix, 0 AS right_id, 0::BIGINT AS cost,
    []::STRUCT(start BIGINT, "end" BIGINT, lex_rank INT, word_id BIGINT, left_id INT, right_id INT, word_cost INT, cost BIGINT)[] AS path FROM lines WHERE text <> ''
  UNION ALL (WITH cur AS (SELECT * FROM dp WHERE step < n)
    SELECT doc_id, sent_id, n, step + 1, e, ix, right_id, cost, path FROM cur WHERE e > step
    UNION ALL
    SELECT doc_id, sent_id, n, step + 1, e, ix, right_id, b.c + word_cost,
      list_append(b.p, {'start': start, 'end': e, 'lex_rank': lex_rank, 'word_id': word_id, 'left_id': left_id, 'right_id': right_id, 'word_cost': word_cost, 'cost': b.c + word_cost}) FROM (
      SELECT c.doc_id, c.sent_id, c.n, c.step, d."end" AS e, d.ix, d.start, d.lex_rank, d.word_id, d.left_id, d.right_id, d.word_cost,
        arg_min({'c': c.cost + coalesce(k.cost, 0), 'p': c.path}, {'c': c.cost + coalesce(k.cost, 0), 'i': -c.ix}) AS b
      FROM cur c JOIN nodes d ON d.doc_id = c.doc_id AND d.sent_id = c.sent_id AND d.start = c.step AND c.e = c.step
      LEFT JOIN cost k ON k.right_id = c.right_id AND k.left_id = d.left_id
      GROUP BY c.doc_id, c.sent_id, c.n, c.step, d."end", d.ix, d.start, d.lex_rank, d.word_id, d.left_id, d.right_id, d.word_cost))),
best AS (SELECT d.doc_id, d.sent_id, arg_min({'c': d.cost + coalesce(k.cost, 0), 'p': d.path}, {'c': d.cost + coalesce(k.cost, 0), 'i': -d.ix}) AS b
  FROM dp d LEFT JOIN cost k ON k.right_id = d.right_id AND k.left_id = 0 WHERE d.step = d.n AND d.e = d.n GROUP BY d.doc_id, d.sent_id),
path AS (SELECT b.doc_id, b.sent_id, b.b.c AS path_cost, (i - 1)::BIGINT AS token_pos, b.b.p[i] AS t FROM best b, unnest(range(1, len(b.b.p) + 1)) AS u(i)),
tokens AS MATERIALIZED (SELECT p.doc_id, p.sent_id, p.path_cost, p.token_pos, substr(l.text, p.t.start + 1, p.t."end" - p.t.start) AS surface, p.t.start AS char_start, p.t."end" AS char_end,
    strlen(substr(l.text, 1, p.t.start)) AS byte_start, strlen(substr(l.text, 1, p.t."end")) AS byte_end, ['User', 'System', 'Unknown'][p.t.lex_rank + 1] AS lex_type, p.t.lex_rank AS lex_rank,
    p.t.word_id AS word_id, p.t.left_id AS left_id, p.t.right_id AS right_id, p.t.word_cost AS word_cost, p.t.cost AS total_cost, coalesce(x.feature, u.feature) AS feature
  FROM path p JOIN lines l ON l.doc_id = p.doc_id AND l.sent_id = p.sent_id
  LEFT JOIN lex x ON x.lex_rank = p.t.lex_rank AND x.word_id = p.t.word_id LEFT JOIN unk u ON p.t.lex_rank = 2 AND u.unk_id = p.t.word_id)"""


#: The same where spaces are skipped: words after a run of spaces hang from its first reached place, whose other places and the one
#: after it start none (``nxt`` is the first that may); a run to the end closes the sentence where it begins (``fin``).
_SPACES = f""",
spaces AS MATERIALIZED (SELECT doc_id, sent_id, pos, pos + g AS w FROM runs WHERE (cate_mask & {1 << [c[0] for c in L.char_def(X.CHAR.splitlines())[0]].index("SPACE")}) <> 0)"""
_SPACED_PATH = _SPACES + _PATH.replace("0::BIGINT AS step,", "0::BIGINT AS step, 0::BIGINT AS nxt, false AS fin,").replace("""(WITH cur AS (SELECT * FROM dp WHERE step < n)
    SELECT doc_id, sent_id, n, step + 1, e, ix, right_id, cost, path FROM cur WHERE e > step
    UNION ALL
    SELECT doc_id, sent_id, n, step + 1, e, ix, right_id, b.c + word_cost,""", """(WITH cur AS (SELECT * FROM dp WHERE step < n AND NOT fin),
    hit AS (SELECT DISTINCT c.doc_id, c.sent_id, coalesce(s.w, c.step) AS w FROM cur c LEFT JOIN spaces s ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id AND s.pos = c.step WHERE c.e = c.step AND c.step >= c.nxt)
    SELECT c.doc_id, c.sent_id, n, step + 1, coalesce(h.w + 1, nxt), false, e, ix, right_id, cost, path FROM cur c LEFT JOIN hit h ON h.doc_id = c.doc_id AND h.sent_id = c.sent_id WHERE e > step AND (h.w IS NULL OR h.w < n)
    UNION ALL
    SELECT c.doc_id, c.sent_id, n, step, nxt, true, e, ix, right_id, cost, path FROM cur c JOIN hit h ON h.doc_id = c.doc_id AND h.sent_id = c.sent_id WHERE e = step AND h.w >= n
    UNION ALL
    SELECT doc_id, sent_id, n, step + 1, start + 1, false, e, ix, right_id, b.c + word_cost,""").replace(
    "FROM cur c JOIN nodes d ON d.doc_id = c.doc_id AND d.sent_id = c.sent_id AND d.start = c.step AND c.e = c.step",
    "FROM cur c JOIN hit h ON h.doc_id = c.doc_id AND h.sent_id = c.sent_id JOIN nodes d ON d.doc_id = c.doc_id AND d.sent_id = c.sent_id AND d.start = h.w AND c.e = c.step",
).replace("WHERE d.step = d.n AND d.e = d.n GROUP BY", "WHERE d.fin OR (d.step = d.n AND d.e = d.n) GROUP BY")
#: Where words hang when spaces are skipped, by the same walk over places alone: (at, w) is a place that is reached and its word place.
_SPACED_EDGES = _SPACES + """,
walk AS (SELECT doc_id, sent_id, length(text) AS n, 0::BIGINT AS step, 0::BIGINT AS nxt, 0::BIGINT AS e, NULL::BIGINT AS spot, NULL::BIGINT AS w FROM lines WHERE text <> ''
  UNION ALL (WITH cur AS (SELECT * FROM walk WHERE step < n AND e IS NOT NULL),
    hit AS (SELECT DISTINCT c.doc_id, c.sent_id, c.n, c.step, coalesce(s.w, c.step) AS w FROM cur c LEFT JOIN spaces s ON s.doc_id = c.doc_id AND s.sent_id = c.sent_id AND s.pos = c.step WHERE c.e = c.step AND c.step >= c.nxt)
    SELECT DISTINCT c.doc_id, c.sent_id, c.n, c.step + 1, coalesce(h.w + 1, c.nxt), c.e, NULL::BIGINT, NULL::BIGINT FROM cur c LEFT JOIN hit h ON h.doc_id = c.doc_id AND h.sent_id = c.sent_id WHERE c.e > c.step AND (h.w IS NULL OR h.w < c.n)
    UNION ALL
    SELECT doc_id, sent_id, n, step, NULL::BIGINT, NULL::BIGINT, step, w FROM hit
    UNION ALL
    SELECT DISTINCT h.doc_id, h.sent_id, h.n, h.step + 1, h.w + 1, d."end", NULL::BIGINT, NULL::BIGINT FROM hit h JOIN nodes d ON d.doc_id = h.doc_id AND d.sent_id = h.sent_id AND d.start = h.w)),
hung AS (SELECT DISTINCT doc_id, sent_id, n, spot, w FROM walk WHERE spot IS NOT NULL),
closed AS (SELECT l.doc_id, l.sent_id, coalesce(min(h.spot), length(any_value(l.text))) AS spot FROM lines l LEFT JOIN hung h ON h.doc_id = l.doc_id AND h.sent_id = l.sent_id AND h.w >= h.n WHERE l.text <> '' GROUP BY 1, 2),
spaced AS (SELECT a.right_id, b.left_id FROM (SELECT d.doc_id, d.sent_id, d."end" AS at, d.right_id FROM nodes d JOIN hung h ON h.doc_id = d.doc_id AND h.sent_id = d.sent_id AND h.w = d.start UNION ALL SELECT doc_id, sent_id, 0, 0 FROM lines WHERE text <> '') a
  JOIN (SELECT d.doc_id, d.sent_id, h.spot AS at, d.left_id FROM nodes d JOIN hung h ON h.doc_id = d.doc_id AND h.sent_id = d.sent_id AND h.w = d.start UNION ALL SELECT doc_id, sent_id, spot, 0 FROM closed) b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.at = b.at)"""


def _sql(select: str, path: bool = False, spaced: bool = False, **options) -> str:
    return f"WITH RECURSIVE {_lattice(**options)}{(_SPACED_PATH if spaced else _PATH) if path else ''}\n{select}"


def _scorer_sql() -> str:
    """The paths of the bigram dictionary: its costs stand in for the matrix."""
    feats = [{0: [""] * X.TEMPLATES} | {int(i): row.split(",") for i, _, row in (line.partition("\t") for line in text.splitlines())} for text in (X.BIGRAM_RIGHT, X.BIGRAM_LEFT)]
    pair = {tuple(names.split("/")): int(cost) for names, cost in (line.split("\t") for line in X.BIGRAM_COST.splitlines())}
    cost = [(r, l, sum(pair.get(p, 0) for p in zip(feats[0][r], feats[1][l]))) for r in feats[0] for l in feats[1]]
    sql, old = _sql(_SHORT, path=True), _tables().split("\n")[-1]
    return sql.replace(old, _values("cost", "right_id, left_id, cost", cost))


def _document_sql(select: str) -> str:
    return _sql(select).replace(_LINES, _DOCUMENT_LINES)


_MAPPING = "SELECT side, id AS old_id, (row_number() OVER (PARTITION BY side ORDER BY prob DESC, id))::INT AS new_id FROM p WHERE id <> 0"


def _raw_sql() -> str:
    def feats(text, columns):
        rows = [(0, k, "") for k in range(X.TEMPLATES)] + [(int(i), k, f) for i, _, row in (line.partition("\t") for line in text.splitlines()) for k, f in enumerate(row.split(","))]
        return _values(columns[0], columns[1], rows)

    pair = {}
    for line in X.BIGRAM_COST.splitlines():
        names, cost = line.split("\t")
        pair[tuple(names.split("/"))] = int(cost)
    more = ",\n".join([feats(X.BIGRAM_RIGHT, ("rfe", "id, k, rf")), feats(X.BIGRAM_LEFT, ("lfe", "id, k, lf")), _values("pairs", "rf, lf, cost", [(*k, v) for k, v in pair.items()])])
    return f"WITH RECURSIVE {_lattice()}, {more}, e AS (SELECT DISTINCT right_id, left_id FROM edges) SELECT e.right_id, e.left_id, coalesce(sum(p.cost), 0)::INT AS cost FROM e JOIN rfe r ON r.id = e.right_id JOIN lfe l ON l.id = e.left_id AND l.k = r.k LEFT JOIN pairs p ON p.rf = r.rf AND p.lf = l.lf GROUP BY 1, 2"


_COUNTS = "counts AS (SELECT side, id, count(*) AS cnt FROM (SELECT 'left' AS side, left_id AS id FROM edges UNION ALL SELECT 'right', right_id FROM edges) GROUP BY 1, 2)"
_CORPUS = "corpus AS (SELECT p_partkey AS example_id, (i - 1)::BIGINT AS token_pos, string_split(p_name, ' ')[i] AS surface, replace(p_type, ' ', ',') || ',' || p_brand AS feature FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS t(i))"
_SHORT = "SELECT doc_id, sent_id, token_pos, surface, lex_type, word_id, total_cost FROM tokens"


def _rewrite_sql() -> str:
    cells = "string_split(feature, ',')"
    c = lambda n: f"coalesce({cells}[{n}], '*')"
    return f"""WITH {_CORPUS} SELECT DISTINCT feature, CASE
 WHEN {c(1)} = 'STANDARD' AND {c(2)} IN ('ANODIZED', 'BRUSHED') THEN 'std,' || {c(3)} || ',' || {c(9)}
 WHEN {c(1)} = 'STANDARD' AND len({cells}) >= 2 THEN 'std,' || {c(2)}
 WHEN {c(3)} = 'STEEL' THEN {c(2)} || ',iron'
 WHEN {c(1)} IN ('PROMO', 'SMALL') THEN {c(1)} || ',x' ELSE feature END AS rewritten FROM corpus"""


def _templates_sql() -> str:
    c = lambda n: f"coalesce(string_split(feature, ',')[{n + 1}], '*')"
    must = lambda n, x: f"CASE WHEN {c(n)} <> '*' THEN {x} END"
    return f"""WITH {_CORPUS} SELECT DISTINCT feature, 'U0:' || {c(0)} AS u0, {must(1, f"'U1:' || {c(1)} || '/' || {c(2)}")} AS u1, 'U2:2-' || {c(7)} AS u2, {must(7, f"'U3:' || {c(7)}")} AS u3, {must(3, f"'B:' || {c(0)} || '+' || {c(3)}")} AS l0 FROM corpus"""


def _part_sql(select: str) -> str:
    """A lattice over the part names' sentences with the lexicon of their words and the tagged unknown entries."""
    sql, tables = _sql("@"), _tables().split(",\n")
    ids = {c[0]: i for i, c in enumerate(L.char_def(X.CHAR.splitlines())[0])}
    unk = sorted(((ids[e[0]], i, e) for i, e in enumerate(_entries(TAGGED_UNKNOWN))), key=lambda x: x[:2])
    number = lambda *c: "('0x' || substr(md5(" + " || '|' || ".join(c) + "), 1, 15))::BIGINT"
    lines = f"{_CORPUS}, lines AS (SELECT example_id AS doc_id, 0::BIGINT AS sent_id, string_agg(surface, '' ORDER BY token_pos) AS text FROM corpus GROUP BY 1)"
    lex = f"lex AS (SELECT 1 AS lex_rank, w AS word_id, surface, (w % 1200)::INT AS left_id, (w % 1100)::INT AS right_id, (w % 900)::INT AS word_cost, feature FROM (SELECT DISTINCT surface, feature, {number('surface', 'feature')} AS w FROM corpus WHERE substr(md5(feature || '|' || surface), 1, 1) < 'c'))"
    sql = sql.replace(_LINES, lines).replace(next(t for t in tables if t.startswith("lex(")), lex)
    sql = sql.replace(next(t for t in tables if t.startswith("unk(")), _values("unk", "unk_id, base_id, left_id, right_id, word_cost, feature", [(k, c, *e[1:]) for k, (c, _, e) in enumerate(unk)]))
    gold = """,
spans AS (SELECT *, coalesce(sum(length(surface)) OVER (PARTITION BY example_id ORDER BY token_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM corpus),
named AS (SELECT feature, substr(surface, 1, 1) AS c, max(word_id) AS word_id FROM lex GROUP BY 1, 2),
met AS (SELECT s.example_id, s.token_pos, s.start, s.start + length(s.surface) AS "end", s.feature, n.word_id, r.base_id, r.grp, r.length, r.g FROM spans s
  LEFT JOIN named n ON n.feature = s.feature AND n.c = substr(s.surface, 1, 1) LEFT JOIN runs r ON r.doc_id = s.example_id AND r.pos = s.start),
fitting AS (SELECT m.example_id, m.token_pos, min(u.unk_id) AS unk_id FROM met m JOIN unk u ON u.base_id = m.base_id
  WHERE m.word_id IS NULL AND (m.grp OR m."end" - m.start <= least(m.length, m.g))
    AND list_bool_and(list_transform(string_split(replace(u.feature, '"', ''), ','), lambda c, i: c = '*' OR coalesce(string_split(m.feature, ',')[i] = c, false))) GROUP BY 1, 2),
gold AS MATERIALIZED (SELECT m.example_id, m.token_pos, m.start, m."end", CASE WHEN m.word_id IS NOT NULL THEN 'word' WHEN f.unk_id IS NOT NULL THEN 'unknown' ELSE 'virtual' END AS kind, coalesce(m.word_id, f.unk_id)::BIGINT AS id
  FROM met m LEFT JOIN fitting f ON f.example_id = m.example_id AND f.token_pos = m.token_pos)
"""
    return sql.replace("\n@", gold + select)


def _remap_sql() -> str:
    left, right = f"CASE WHEN left_id = 0 THEN 0 ELSE {X.SIZE} - left_id END", f"CASE WHEN right_id = 0 THEN 0 WHEN right_id = 1 THEN {X.SIZE - 1} ELSE right_id - 1 END"
    return f"WITH {_tables()} SELECT 'lexicon' AS part, word_id::BIGINT AS k, {left} AS left_id, {right} AS right_id, word_cost AS cost FROM lex UNION ALL SELECT 'unknown', unk_id, {left}, {right}, word_cost FROM unk UNION ALL SELECT 'matrix', 0, {left}, {right}, cost FROM cost"


def oracle_sql() -> dict[str, str]:
    return {
        "char_positions": f"WITH {_LINES}, c AS (SELECT doc_id, sent_id, p - 1 AS pos, substr(text, p, 1) AS ch FROM lines, unnest(range(1, length(text) + 1)) AS t(p) WHERE text <> '') SELECT doc_id, sent_id, pos, ch, unicode(ch)::BIGINT AS cp, coalesce(sum(strlen(ch)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_pos FROM c",
        "char_categories": _sql("SELECT doc_id, sent_id, pos, cp, base_id, cate_mask, invoke, grp, length FROM infos"),
        "char_info_packed": _sql("SELECT DISTINCT ch, (cate_mask + base_id * 262144 + invoke::INT * 67108864 + grp::INT * 134217728 + length::BIGINT * 268435456)::BIGINT AS packed, cate_mask::INT AS cate_mask, base_id::INT AS base_id, invoke, grp, length::INT AS length FROM infos"),
        "groupable_runs": _sql("SELECT doc_id, sent_id, pos, g AS groupable FROM runs"),
        "prefix_matches": _sql("SELECT * FROM matches"),
        "unknown_candidates": _sql("SELECT * FROM unks"),
        "lattice_nodes": _sql("SELECT * FROM nodes"),
        "lattice_reachable": _sql("SELECT doc_id, sent_id, count(*) AS n_nodes, sum(ix)::BIGINT AS ix_sum FROM live GROUP BY 1, 2"),
        "lattice_edges": _sql("SELECT right_id, left_id, count(*) AS cnt FROM edges GROUP BY 1, 2"),
        "connection_cost_matrix": _sql("SELECT e.right_id, e.left_id, count(*) AS cnt, coalesce(any_value(k.cost), 0) AS cost FROM edges e LEFT JOIN cost k ON k.right_id = e.right_id AND k.left_id = e.left_id GROUP BY 1, 2"),
        "connection_cost_raw": _raw_sql(),
        "gold_alignment": _part_sql("SELECT * FROM gold"),
        "training_edges": _part_sql("""SELECT example_id, start, "end", kind, id, true AS gold FROM gold UNION ALL
SELECT e.* FROM (SELECT doc_id AS example_id, start, "end", CASE WHEN lex_rank = 2 THEN 'unknown' ELSE 'word' END AS kind, word_id::BIGINT AS id, false AS gold FROM (SELECT * FROM matches UNION ALL SELECT * FROM unks)) e
ANTI JOIN gold g ON g.example_id = e.example_id AND g.start = e.start AND g."end" = e."end" AND g.kind = e.kind AND g.id = e.id"""),
        "postings_parts": _part_sql("SELECT surface, string_agg(word_id::VARCHAR, ',' ORDER BY word_id) AS word_ids FROM lex GROUP BY 1"),
        "validation_parts": _part_sql("SELECT feature, count(*) AS bad, min(word_id) AS least FROM lex WHERE left_id >= 1050 OR right_id >= 1000 GROUP BY 1"),
        "labels_parts": _part_sql("SELECT row_number() OVER (ORDER BY word_id) AS label_id, 'word' AS kind, word_id AS id, feature, substr(surface, 1, 1) AS first_char FROM lex UNION ALL SELECT unk_id + 1 + (SELECT count(*) FROM lex), 'unknown', unk_id, feature, NULL FROM unk"),
        "tokens_lateral": _sql("SELECT doc_id, sent_id, token_pos, surface, char_start, char_end, lex_type, word_id::BIGINT AS word_id, left_id, right_id, word_cost, total_cost FROM tokens", path=True),
        "connection_cost_scorer": _raw_sql(),
        "connection_cost_dual": _raw_sql(),
        "tokens_scorer": _scorer_sql(),
        "tokens_mapped": _sql(_SHORT, path=True, user=True),
        "tokens_ignore_space": _sql("SELECT doc_id, sent_id, token_pos, surface, char_start, char_end, lex_type, word_id, total_cost FROM tokens", path=True, spaced=True),
        "connid_counts_ignore_space": _sql("@").replace("\n@", f"{_SPACED_EDGES}, {_COUNTS.replace('FROM edges', 'FROM spaced')} SELECT * FROM counts"),
        "connid_counts_documents": _document_sql("@").replace("\n@", f", {_COUNTS} SELECT * FROM counts"),
        "tokens_detail": _sql("SELECT doc_id, sent_id, token_pos, surface, char_start, char_end, byte_start, byte_end, lex_type, word_id, left_id, right_id, word_cost, total_cost, feature FROM tokens", path=True),
        "best_path_fold": _sql('SELECT doc_id, sent_id, path_cost, token_pos, char_start AS start, char_end AS "end", lex_rank, word_id FROM tokens', path=True),
        "tokens_wakati": _sql("SELECT l.doc_id, l.sent_id, coalesce(string_agg(t.surface, ' ' ORDER BY t.token_pos), '') AS out FROM lines l LEFT JOIN tokens t ON t.doc_id = l.doc_id AND t.sent_id = l.sent_id GROUP BY 1, 2", path=True),
        "tokens_lines": _sql("SELECT l.doc_id, l.sent_id, coalesce(string_agg(t.surface || chr(9) || t.feature || chr(9) || 'lex_type=' || t.lex_type || chr(9) || 'left_id=' || t.left_id || chr(9) || 'right_id=' || t.right_id || chr(9) || 'word_cost=' || t.word_cost || chr(9) || 'total_cost=' || t.total_cost, chr(10) ORDER BY t.token_pos) || chr(10), '') || 'EOS' AS out FROM lines l LEFT JOIN tokens t ON t.doc_id = l.doc_id AND t.sent_id = l.sent_id GROUP BY 1, 2", path=True),
        "tokens_user_lexicon": _sql(_SHORT, path=True, user=True),
        "tokens_max_grouping": _sql(_SHORT, path=True, most_run=4),
        "token_counts": _sql("SELECT doc_id, sent_id, count(*) AS n_tokens, max(total_cost) AS last_cost FROM tokens GROUP BY 1, 2", path=True),
        "connid_counts": _sql("SELECT * FROM counts").replace("\nSELECT * FROM counts", f", {_COUNTS} SELECT * FROM counts"),
        "connid_probs": _sql("@").replace("\n@", f", {_COUNTS}, ids AS (SELECT s.side, i::INT AS id FROM (VALUES ('left'), ('right')) s(side), range({X.SIZE}) t(i)), p AS (SELECT side, id, coalesce(cnt, 0)::DOUBLE / sum(coalesce(cnt, 0)) OVER (PARTITION BY side) AS prob FROM ids LEFT JOIN counts USING (side, id)) SELECT side, id, round(prob, 6) AS prob, row_number() OVER (PARTITION BY side ORDER BY prob DESC, id) AS rank FROM p WHERE id <> 0"),
        "connid_remap": _remap_sql(),
        "remap_invariance": _sql("SELECT doc_id, sent_id, token_pos, surface, word_id, word_cost, total_cost FROM tokens", path=True),
        "homograph_postings": f"WITH {_tables()} SELECT surface, string_agg(word_id::VARCHAR, ',' ORDER BY word_id) AS word_ids FROM lex GROUP BY 1",
        "dictionary_validation": f"WITH {_tables(True)} SELECT 'lexicon' AS part, count(*) AS bad FROM lex WHERE lex_rank = 1 AND (left_id >= 7 OR right_id >= 7) UNION ALL SELECT 'unknown', count(*) FROM unk WHERE left_id >= 7 OR right_id >= 7 UNION ALL SELECT 'user', count(*) FROM lex WHERE lex_rank = 0 AND (left_id >= 7 OR right_id >= 7)",
        "corpus_sentences": f"WITH {_CORPUS} SELECT example_id AS doc_id, 0::BIGINT AS sent_id, string_agg(surface, '' ORDER BY token_pos) AS text FROM corpus GROUP BY 1",
        "corpus_lines": f"WITH {_CORPUS} SELECT example_id, string_agg(surface || chr(9) || feature, chr(10) ORDER BY token_pos) || chr(10) || 'EOS' AS out FROM corpus GROUP BY 1",
        "corpus_split": "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN p <= floor(n * 0.1::DOUBLE) THEN 'valid' WHEN p <= floor(n * 0.1::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM p",
        "eval_prf": _sql("""SELECT g.gold, s.system, b.both, round(b.both::DOUBLE / s.system, 6) AS precision, round(b.both::DOUBLE / g.gold, 6) AS recall, round(2.0 * b.both / (g.gold + s.system), 6) AS f1
FROM (SELECT count(*) AS gold FROM gold) g, (SELECT count(*) AS system FROM (SELECT DISTINCT doc_id, sent_id, char_start, char_end, string_split(feature, ',')[1] FROM tokens)) s,
(SELECT count(*) AS both FROM gold JOIN (SELECT DISTINCT doc_id, sent_id, char_start, char_end, string_split(feature, ',')[1] AS f FROM tokens) t USING (doc_id, sent_id, char_start, char_end) WHERE t.f = 'VERB') b""", path=True).replace("\nSELECT g.gold", """, words AS (SELECT doc_id, sent_id, i, string_split(text, ' ')[i] AS w FROM lines, unnest(range(1, len(string_split(text, ' ')) + 1)) AS t(i) WHERE text <> ''),
places AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM words),
gold AS (SELECT DISTINCT doc_id, sent_id, char_start, char_start + length(w) AS char_end FROM places WHERE w <> '')
SELECT g.gold"""),
        "feature_rewrite": _rewrite_sql(),
        "feature_templates": _templates_sql(),
        "label_table": f"WITH {_tables()}, n AS (SELECT count(*) AS n FROM lex) SELECT (word_id + 1)::BIGINT AS label_id, 'word' AS kind, feature, substr(surface, 1, 1) AS first_char FROM lex UNION ALL SELECT unk_id + 1 + n.n, 'unknown', feature, NULL FROM unk, n",
        "weight_scaling": "SELECT p_partkey, trunc(-(p_retailprice - 1400.0::DOUBLE) * (32767.0::DOUBLE / (SELECT max(abs(p_retailprice - 1400.0::DOUBLE)) FROM part)))::INT AS cost FROM part",
        "bench_stats": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS up, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS down, count(*) OVER (PARTITION BY event_type) AS n, sum(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type) - max(value) OVER (PARTITION BY event_type) AS rest FROM events WHERE value IS NOT NULL), k AS (SELECT event_type, any_value(n) - 2 AS kept, round(min(CASE WHEN up = 2 THEN value END), 6) AS least, round(any_value(rest) / (any_value(n) - 2), 6) AS mean, round(min(CASE WHEN down = 2 THEN value END), 6) AS most FROM r WHERE n > 2 GROUP BY event_type) SELECT * FROM k",
        "word_counts_documents": _document_sql("SELECT lex_rank, word_id::BIGINT AS word_id, count(*) AS cnt FROM matches GROUP BY 1, 2"),
        "lattice_counts_documents": _document_sql('SELECT lex_rank, "end" - start AS n_chars, count(*) AS cnt, sum(ix)::BIGINT AS ix_sum FROM nodes GROUP BY 1, 2'),
        "mapping_file": _sql("@").replace("\n@", f", {_COUNTS}, ids AS (SELECT s.side, i::INT AS id FROM (VALUES ('left'), ('right')) s(side), range({X.SIZE}) t(i)), p AS (SELECT side, id, coalesce(cnt, 0)::DOUBLE / sum(coalesce(cnt, 0)) OVER (PARTITION BY side) AS prob FROM ids LEFT JOIN counts USING (side, id)) {_MAPPING}"),
        "lexicon_scraped": "SELECT p_partkey AS line_no, '\"\"\"' || p_name || ', x\"\"\",1,2,3,' || concat_ws('-', string_split(p_type, ' ')[1], string_split(p_type, ' ')[2]) || ',' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS value FROM part",
        "text_model_costs": "SELECT * FROM (SELECT c_mktsegment || '/' || c_name AS feature, trunc(-(printf('%.2f', c_acctbal / 1000)::DOUBLE) * 7.0::DOUBLE)::INT AS cost FROM customer) WHERE cost <> 0",
    }
