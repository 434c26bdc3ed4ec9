"""Tagged sentences against a dictionary: the edges that are right, and all others of their lattices, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lines import cells
from . import lattice as N

#: Unknown entries up to which a broadcast carries them.
FEW_ENTRIES = 10_000
WORD, UNKNOWN, VIRTUAL = "word", "unknown", "virtual"


def token_spans(corpus: DataFrame) -> DataFrame:
    """``corpus(example_id, token_pos, surface, feature)`` with start and end, in characters of the sentence that the surfaces make."""
    before = Window.partitionBy("example_id").orderBy("token_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("surface")).over(before), F.lit(0)).cast("long")
    return corpus.select("example_id", "token_pos", "surface", "feature", start.alias("start")).withColumn("end", (F.col("start") + F.length("surface")).cast("long"))


def word_labels(lexicon: DataFrame) -> DataFrame:
    """(feature, first_char, word_id): words of one feature and first character share a label, that of the last of them."""
    return lexicon.groupBy("feature", F.substring("surface", 1, 1).alias("first_char")).agg(F.max("word_id").alias("word_id"))


def compatible(pattern: Column, feature: Column) -> Column:
    """Whether every cell of ``pattern`` is ``*`` or the feature's cell of that place."""
    row = cells(feature)
    return F.coalesce(F.forall(F.transform(cells(pattern), lambda c, i: (c == "*") | F.coalesce(F.get(row, i) == c, F.lit(False))), lambda ok: ok), F.lit(True))


def gold_edges(corpus: DataFrame, lexicon: DataFrame, unknown: DataFrame, runs: DataFrame) -> DataFrame:
    """(example_id, token_pos, start, end, kind, id): the label of every token of ``corpus``.

    A word of the lexicon with the token's feature and first character, else the first
    unknown entry of the first character's base category whose cells are ``*`` or the token's, else
    none (virtual, id null).  Categories that do not group have unknown words of their
    length, and of the run from there, at most.  ``runs`` are ``groupable_runs`` of the sentences, doc_id being
    example_id.  Tokens meet the lexicon by key; unknown entries meet the distinct features of
    each category only, of which the smallest entry that fits is kept.
    """
    tokens = token_spans(corpus)
    named = word_labels(lexicon)
    rows = tokens.withColumn("first_char", F.substring("surface", 1, 1)).join(named, ["feature", "first_char"], "left")
    at = runs.select(F.col("doc_id").alias("example_id"), F.col("pos").alias("start"), "base_id", "group", "length", "groupable")
    rows = rows.join(at, ["example_id", "start"], "left")
    fits = F.col("group") | (F.col("end") - F.col("start") <= F.least(F.col("length").cast("long"), F.col("groupable")))
    rows = rows.withColumn("open", F.col("word_id").isNull() & F.coalesce(fits, F.lit(False)))
    kinds = rows.where("open").select("base_id", "feature").distinct()
    entries = unknown.select(F.col("cate_id").alias("base_id"), "unk_id", F.col("feature").alias("pattern"))
    if unknown.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES:
        entries = F.broadcast(entries)
    found = kinds.join(entries, "base_id").where(compatible(F.col("pattern"), F.col("feature"))).groupBy("base_id", "feature").agg(F.min("unk_id").alias("unk_id"))
    rows = rows.join(found.withColumn("open", F.lit(True)), ["base_id", "feature", "open"], "left")
    kind = F.when(F.col("word_id").isNotNull(), WORD).when(F.col("unk_id").isNotNull(), UNKNOWN).otherwise(VIRTUAL)
    return rows.select("example_id", "token_pos", "start", "end", kind.alias("kind"), F.coalesce("word_id", "unk_id").alias("id"))


def training_edges(gold: DataFrame, matches: DataFrame | None, unknowns: DataFrame) -> DataFrame:
    """(example_id, start, end, kind, id, gold): the gold edges, and every other word and unknown word of the lattices.

    ``matches`` and ``unknowns`` are those of the sentences (system words only; None: no words), reachable or not; what equals a
    gold edge is not repeated.
    """
    other = lambda df, kind: df.select(F.col("doc_id").alias("example_id"), "start", "end", F.lit(kind).alias("kind"), F.col("word_id").alias("id"))
    every = other(unknowns, UNKNOWN) if matches is None else other(matches, WORD).unionAll(other(unknowns, UNKNOWN))
    wrong = every.join(gold.where(F.col("kind") != VIRTUAL).select("example_id", "start", "end", "kind", "id"), ["example_id", "start", "end", "kind", "id"], "left_anti")
    right = gold.select("example_id", "start", "end", "kind", "id", F.lit(True).alias("gold"))
    return right.unionAll(wrong.select("example_id", "start", "end", "kind", "id", F.lit(False)))


def surface_edges(gold: DataFrame, sentences: DataFrame, runs: DataFrame, lexicon: DataFrame, unknown: DataFrame) -> DataFrame:
    """What ``training_edges`` gives of a lexicon in which many words may have one surface.

    Places meet surfaces, and the gold word of the place, before each becomes all words of its surface: with a
    lexicon that can be broadcast no shuffle carries a row for each edge.  A place has one gold word at most, as tokens do not overlap.
    """
    surfaces = lexicon.select("surface").distinct()
    hits = N.substrings(sentences, surfaces).join(surfaces, "surface", "left_semi")
    own = gold.where((F.col("kind") == WORD) & (F.col("end") > F.col("start"))).select(F.col("example_id").alias("doc_id"), "start", "end", F.col("id").alias("own"))
    words = hits.join(own, ["doc_id", "start", "end"], "left").join(lexicon.select("surface", "word_id"), "surface").where("own IS NULL OR own <> word_id")
    few = training_edges(gold, None, N.unknown_candidates(runs, hits, unknown))
    return few.unionAll(words.select(F.col("doc_id").alias("example_id"), "start", "end", F.lit(WORD).alias("kind"), F.col("word_id").alias("id"), F.lit(False)))


def sentence_runs(corpus: DataFrame, categories: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentences, groupable runs) of a tagged corpus."""
    rows = corpus.groupBy("example_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "surface"))), lambda x: x.surface), "").alias("text"))
    sentences = rows.select(F.col("example_id").alias("doc_id"), F.lit(0).cast("long").alias("sent_id"), "text")
    return sentences, N.groupable_runs(N.char_infos(N.char_positions(sentences), categories, points))
