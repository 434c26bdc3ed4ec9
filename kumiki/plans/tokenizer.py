"""The tokenizer as a DataFrame transformation, its output formats and its accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators import viterbi as V
from ..operators.lattice import SENT
from ..shipping import ship
from ..sources.lines import cells, quoted
from .dictionary import Dictionary


def _spread(sentences: DataFrame) -> DataFrame:
    """Few large input files would leave cores idle in the fold; otherwise rows stay where they are."""
    if sentences.isStreaming:
        return sentences
    cores = sentences.sparkSession.sparkContext.defaultParallelism
    return sentences.repartition(cores) if sentences.rdd.getNumPartitions() < cores else sentences


def evened(table: DataFrame) -> DataFrame:
    """A table's rows, dealt anew where one of its splits holds over twice a core's share, as where files have few large row groups; only row numbers are read to tell."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    splits = table.rdd.getNumPartitions()
    if splits < cores:  # the fold spreads these
        return table
    rows = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    return table.repartition(splits) if rows and max(rows) * cores > 2 * sum(rows) else table


class Tokenizer:
    """Options and a dictionary; works alike on static and streaming sentences.  ``mapped`` and ``scorer`` are those of ``Dictionary.packed``."""

    def __init__(self, dictionary: Dictionary, ignore_space: bool = False, max_grouping_len: int = 0, strict: bool = False, mapped: bool | None = None, scorer: bool | None = None):
        spark = dictionary.lexicon.sparkSession
        self.dictionary, self.options, self.strict = dictionary, (ignore_space, max_grouping_len), strict
        if ignore_space and dictionary.categories.where("name = 'SPACE'").isEmpty():
            raise InvalidArgument("ignoring spaces needs a category SPACE")
        if max_grouping_len < 0:
            raise InvalidArgument("max_grouping_len must not be negative")
        self._compact = ship(spark).sparkContext.broadcast(dictionary.packed(mapped, scorer))

    def transform(self, sentences: DataFrame) -> DataFrame:
        """One row for each token of ``sentences(doc_id, sent_id, text)``, without features; no shuffle."""
        return _spread(sentences.select(*SENT, "text")).mapInArrow(V.tokenize_batches(self._compact, *self.options, self.strict), f"doc_id long, sent_id long, {V.TOKEN}")

    def with_features(self, tokens: DataFrame) -> DataFrame:
        names = F.create_map(*[x for i, n in enumerate(V.RANKS) for x in (F.lit(i), F.lit(n))])
        feats = self.dictionary.features().select(names[F.col("lex_rank")].alias("lex_type"), "word_id", "feature")
        return tokens.join(feats, ["lex_type", "word_id"], "left").select(*tokens.columns, "feature")

    def _pieces(self, sentences: DataFrame) -> tuple[DataFrame, int]:
        """(piece, place, cnt) of sentences, and the right id before pieces that do not begin one.

        Where all paths go through every space, sentences are cut behind spaces and equal pieces are folded once, with
        their counts: there are far fewer different pieces than words.  Else a piece is a sentence.
        """
        fence = None if self.options[0] or sentences.isStreaming else self._compact.value.fence
        rows = _spread(sentences.select("text")).mapInArrow(V.cut_batches(fence), V.PIECE)
        return (rows.groupBy("piece", "place").agg(F.sum("cnt").alias("cnt")), fence[0]) if fence else (rows, 0)

    def connid_counts(self, sentences: DataFrame) -> DataFrame:
        """(side, id, cnt) over all pairs of the reachable lattices; batches are added up before the shuffle."""
        pieces, right = self._pieces(sentences)
        rows = pieces.mapInArrow(V.count_batches(self._compact, right, *self.options), "side string, id int, cnt long")
        return rows.groupBy("side", "id").agg(F.sum("cnt").alias("cnt"))

    def surface_counts(self, sentences: DataFrame) -> DataFrame:
        """(surface, lex_type, cnt, least_cost) over all tokens; batches are added up before the shuffle."""
        pieces, right = self._pieces(sentences)
        rows = pieces.mapInArrow(V.surface_batches(self._compact, right, *self.options), V.SURFACE_COUNT)
        return rows.groupBy("surface", "lex_type").agg(F.sum("cnt").alias("cnt"), F.min("least_cost").alias("least_cost"))

    def totals(self, sentences: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, most) of each document with tokens or a sentence without a path: its tokens, and the largest total cost up to one of them."""
        rows = _spread(sentences.select("doc_id", "text")).mapInArrow(V.total_batches(self._compact, *self.options), V.TOTAL)
        return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("most").alias("most"))

    def node_counts(self, sentences: DataFrame) -> DataFrame:
        """(lex_rank, word_id, n_chars, cnt, ix_sum) over all nodes of the lattices, reached or not; batches are added up before the shuffle.

        ix_sum adds up the nodes' places among those that end together; spaces are not ignored.
        """
        if self.options[0]:
            raise InvalidArgument("nodes are counted with their spaces")
        rows = self._pieces(sentences)[0].mapInArrow(V.node_batches(self._compact, self.options[1]), V.NODE_COUNT)
        return rows.groupBy("lex_rank", "word_id", "n_chars").agg(F.sum("cnt").alias("cnt"), F.sum("ix_sum").alias("ix_sum"))


def _joined(tokens: DataFrame, sentences: DataFrame, line: Column, sep: str) -> DataFrame:
    rows = tokens.where("token_pos is not null").groupBy(*SENT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", line.alias("v")))), lambda x: x.v), sep).alias("out"))
    return sentences.select(*SENT).join(rows, SENT, "left").withColumn("out", F.coalesce("out", F.lit("")))


def wakati(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, out): surfaces joined by a space."""
    return _joined(tokens, sentences, F.col("surface"), " ")


def lines_format(tokens: DataFrame, sentences: DataFrame, detail: bool = False) -> DataFrame:
    """(doc_id, sent_id, out): a line ``surface<TAB>feature`` for each token, then EOS; with ``detail`` the type, ids and costs follow."""
    columns = ["surface", "feature"] + (["lex_type", "left_id", "right_id", "word_cost", "total_cost"] if detail else [])
    if detail:
        line = F.concat(F.col("surface"), F.lit("\t"), F.col("feature"), *[x for c, n in zip(columns[2:], ("lex_type=", "left_id=", "right_id=", "word_cost=", "total_cost=")) for x in (F.lit("\t" + n), F.col(c).cast("string"))])
    else:
        line = F.concat_ws("\t", *columns)
    rows = _joined(tokens, sentences, line, "\n")
    return rows.withColumn("out", F.when(F.col("out") == "", "EOS").otherwise(F.concat("out", F.lit("\nEOS"))))


def corpus_sentences(corpus: DataFrame) -> DataFrame:
    """(doc_id, sent_id, text): the surfaces of each example side by side."""
    rows = corpus.groupBy("example_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "surface"))), lambda x: x.surface), "").alias("text"))
    return rows.select(F.col("example_id").alias("doc_id"), F.lit(0).cast("long").alias("sent_id"), "text")


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """(example_id, out): the examples as text, each closed by EOS."""
    rows = corpus.groupBy("example_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", F.concat_ws("\t", "surface", "feature").alias("v")))), lambda x: x.v), "\n").alias("out"))
    return rows.withColumn("out", F.concat("out", F.lit("\nEOS")))


def corpus_split(examples: DataFrame, key: str, valid: float, test: float, seed: int = 0) -> DataFrame:
    """Adds part: exactly floor(n * valid) rows are valid, the next floor(n * test) test, the rest train, in the order of a keyed digest.

    The digest's leading bits cut the rows into ranges; counts of the ranges give each its offset.
    """
    if not (0 <= valid <= 1 and 0 <= test <= 1 and valid + test <= 1):
        raise InvalidArgument("ratios lie in 0..1 and together not above 1")
    rows = examples.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy())).drop("_c")
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.col("_o")
    rows = rows.join(F.broadcast(counts), "_b").withColumn("_p", place)
    v, t = F.floor(F.col("_n") * valid), F.floor(F.col("_n") * test)
    return rows.withColumn("part", F.when(F.col("_p") <= v, "valid").when(F.col("_p") <= v + t, "test").otherwise("train")).select(*examples.columns, "part")


def picked(feature: Column, indices: list[int]) -> Column:
    """Chosen cells of a feature, quoted where they must be, missing ones as ``*``."""
    row = cells(feature)
    return F.concat_ws(",", *[quoted(F.coalesce(F.get(row, F.lit(i)), F.lit("*"))) for i in indices])


def ratio(text: str) -> float:
    """A share from 0 to 1."""
    value = float(text)
    if not 0 <= value <= 1:
        raise ValueError("a ratio lies in 0..1")
    return value


def corpus_spans(corpus: DataFrame, indices: list[int]) -> DataFrame:
    """(doc_id, sent_id, char_start, char_end, features) of the tokens of tagged examples."""
    before = Window.partitionBy("example_id").orderBy("token_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("surface")).over(before), F.lit(0)).cast("long")
    rows = corpus.select(F.col("example_id").alias("doc_id"), F.lit(0).cast("long").alias("sent_id"), start.alias("char_start"), F.length("surface").alias("n"), picked(F.col("feature"), indices).alias("features"))
    return rows.select("doc_id", "sent_id", "char_start", (F.col("char_start") + F.col("n")).alias("char_end"), "features")


def accuracy(gold: DataFrame, system: DataFrame) -> DataFrame:
    """precision, recall, f1 of distinct (doc_id, sent_id, char_start, char_end, features) rows; null where undefined."""
    keys = [*SENT, "char_start", "char_end", "features"]
    g, s = gold.select(*keys).distinct(), system.select(*keys).distinct()
    one = g.agg(F.count("*").alias("gold")).join(s.agg(F.count("*").alias("system"))).join(g.intersect(s).agg(F.count("*").alias("both")))
    p, r = F.try_divide(F.col("both").cast("double"), F.col("system")), F.try_divide(F.col("both").cast("double"), F.col("gold"))
    return one.select("gold", "system", "both", p.alias("precision"), r.alias("recall"), F.try_divide(2.0 * F.col("both"), F.col("gold") + F.col("system")).alias("f1"))


def demo_view(tokens: DataFrame) -> DataFrame:
    """surface, pos and pron: the first two feature cells, empty where missing."""
    row = F.split("feature", ",")
    return tokens.select(*SENT, "token_pos", "surface", F.coalesce(F.get(row, F.lit(0)), F.lit("")).alias("pos"), F.coalesce(F.get(row, F.lit(1)), F.lit("")).alias("pron"))
