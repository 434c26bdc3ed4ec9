"""The lattice of a sentence as joins and windows: characters, runs, matches, unknown words, nodes, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENT = ["doc_id", "sent_id"]
#: Order of nodes that end at one place: user words, system words, unknown words.
USER, SYSTEM, UNKNOWN = 0, 1, 2


def char_positions(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, ch, cp, byte_pos) of every code point; empty sentences have no row."""
    rows = sentences.where("text <> ''").select(*SENT, F.posexplode(F.split("text", "")).alias("pos", "ch"))
    before = Window.partitionBy(*SENT).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*SENT, F.col("pos").cast("long").alias("pos"), "ch")
    return rows.select("*", F.ascii("ch").cast("long").alias("cp"), F.coalesce(F.sum(F.octet_length("ch")).over(before), F.lit(0)).cast("long").alias("byte_pos"))


def char_infos(chars: DataFrame, categories: DataFrame, points: DataFrame) -> DataFrame:
    """Adds base_id, cate_mask, invoke, group, length; code points without an entry are DEFAULT, those above U+FFFF are as U+0000."""
    known = F.when(F.col("cp") < 65536, F.col("cp")).otherwise(0)
    rows = chars.withColumn("k", known).join(F.broadcast(points.withColumnRenamed("cp", "k")), "k", "left").drop("k")
    rows = rows.withColumn("base_id", F.coalesce("base_id", F.lit(0))).withColumn("cate_mask", F.coalesce("cate_mask", F.lit(1)))
    return rows.join(F.broadcast(categories.select(F.col("cate_id").alias("base_id"), "invoke", "group", "length")), "base_id")


#: Bits of a packed character info: categories, base category, invoke, group, length.
_BITS = (("cate_mask", 18), ("base_id", 8), ("invoke", 1), ("group", 1), ("length", 4))


def packed_info() -> Column:
    """The five fields of a character info as one number."""
    out, at = F.lit(0).cast("long"), 0
    for name, bits in _BITS:
        out, at = out.bitwiseOR(F.shiftleft(F.col(name).cast("long"), at)), at + bits
    return out


def unpacked_info(packed: Column) -> list[Column]:
    """The five fields of a packed character info."""
    out, at = [], 0
    for name, bits in _BITS:
        field = F.shiftright(packed, at).bitwiseAND((1 << bits) - 1)
        out.append(field.cast("boolean" if bits == 1 else "int").alias(name))
        at += bits
    return out


def groupable_runs(infos: DataFrame) -> DataFrame:
    """Adds groupable: length of the run from here on in which neighbours share a category."""
    order = Window.partitionBy(*SENT).orderBy("pos")
    rows = infos.withColumn("_cut", F.when(F.coalesce(F.lead("cate_mask").over(order).bitwiseAND(F.col("cate_mask")) == 0, F.lit(True)), F.col("pos")))
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("groupable", F.min("_cut").over(ahead) - F.col("pos") + 1).drop("_cut")


def postings(lexicon: DataFrame) -> DataFrame:
    """(surface, word_ids): the numbers of each surface's words, rising."""
    return lexicon.groupBy("surface").agg(F.array_sort(F.collect_list("word_id")).alias("word_ids"))


def unknown_ids(words: DataFrame, num_left: int, num_right: int) -> DataFrame:
    """The words with a connection id that a matrix of these sizes has not; both are counted from 0."""
    return words.where((F.col("left_id") >= num_left) | (F.col("right_id") >= num_right) | (F.least("left_id", "right_id") < 0))


def labels(lexicon: DataFrame, unknown: DataFrame) -> DataFrame:
    """(label_id, kind, id, feature, first_char): labels 1, 2, ... of words in order of their numbers, then of unknown entries.

    Words are numbered in two levels, within ranges of their numbers and over the ranges.
    """
    rows = numbered(lexicon.select(F.lit("word").alias("kind"), F.col("word_id").alias("id"), "feature", F.substring("surface", 1, 1).alias("first_char")), "id", "label_id")
    more = unknown.select(F.lit("unknown").alias("kind"), F.col("unk_id").alias("id"), "feature", F.lit(None).cast("string").alias("first_char"), (F.col("unk_id") + 1 + lexicon.count()).alias("label_id"))
    columns = ["label_id", "kind", "id", "feature", "first_char"]
    return rows.withColumn("label_id", F.col("label_id") + 1).select(columns).unionAll(more.select(columns))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in order of a column of whole numbers, ties in any order.

    A sample of the numbers cuts them into ranges; a row's place in its range and the sizes of
    the ranges before make its number, so that no task has all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [c for c in rows.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 1000).alias("c")).first().c or []] if parts > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<bigint>"), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = rows.withColumn("_range", place)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_range", ahead.alias("_ahead")))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return rows.join(sizes, "_range").withColumn(name, (own + F.col("_ahead")).cast("long")).drop("_range", "_ahead")


def substrings(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, sent_id, start, end, surface): every substring that is as long as some word of ``lexicon``.

    The lengths are collected; substrings are cut from the line's characters, so a row carries its own only.
    """
    lengths = sorted(r.n for r in lexicon.select(F.length("surface").alias("n")).distinct().collect())
    if not lengths:
        lengths = [1]
    sizes = F.array(*[F.lit(n) for n in lengths])
    chars = F.transform(F.array(F.split("text", "")), lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.transform(F.filter(sizes, lambda n: i + n <= F.size(c)), lambda n: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice(c, i + 1, n), "").alias("surface"))))))
    rows = sentences.where("text <> ''").select(*SENT, F.explode(F.element_at(chars, 1)).alias("m"))
    return rows.select(*SENT, F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.surface")


def prefix_matches(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, sent_id, start, end, lex_rank, word_id, left_id, right_id, word_cost): every word at every place.

    A hash join on the substring.  ``lexicon`` carries lex_rank (user words before system words).
    """
    return substrings(sentences, lexicon).join(lexicon, "surface").select(*SENT, "start", "end", "lex_rank", "word_id", "left_id", "right_id", "word_cost")


def unknown_candidates(runs: DataFrame, matches: DataFrame, unknown: DataFrame, max_grouping_len: int = 0) -> DataFrame:
    """(doc_id, sent_id, start, end, lex_rank, word_id, left_id, right_id, word_cost) of unknown words.

    None where a word matched and the category does not invoke them.  A grouping
    category gives the whole run unless it is over long; lengths 1 to ``length``
    follow, the whole run not again; where nothing was tried and no word matched,
    one character.  Each stands for all entries of the base category.
    """
    hit = matches.select(*SENT, F.col("start").alias("pos")).distinct().withColumn("matched", F.lit(True))
    rows = runs.join(hit, [*SENT, "pos"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    rows = rows.where(~F.col("matched") | F.col("invoke"))
    g = F.col("groupable")
    whole = F.col("group") & ((F.lit(max_grouping_len) == 0) | (g - 1 <= max_grouping_len))
    most = F.least(F.col("length").cast("long"), g)
    some = F.when(most >= 1, F.filter(F.sequence(F.lit(1).cast("long"), most), lambda n: ~(F.col("group") & (n == g)))).otherwise(F.array().cast("array<bigint>"))
    lens = F.concat(F.when(whole, F.array(g)).otherwise(F.array().cast("array<bigint>")), some)
    lens = F.when((F.size(lens) == 0) & ~F.col("matched"), F.array(F.lit(1).cast("long"))).otherwise(lens)
    rows = rows.select(*SENT, F.col("pos").alias("start"), "base_id", F.explode(lens).alias("n"))
    rows = rows.join(F.broadcast(unknown.withColumnRenamed("cate_id", "base_id")), "base_id")
    return rows.select(*SENT, "start", (F.col("start") + F.col("n")).alias("end"), F.lit(UNKNOWN).alias("lex_rank"), F.col("unk_id").alias("word_id"), "left_id", "right_id", "word_cost")


def lattice_nodes(matches: DataFrame, unknown: DataFrame) -> DataFrame:
    """All nodes with ix, their place among those that end together; starts that no path reaches are included."""
    order = Window.partitionBy(*SENT, "end").orderBy("start", "lex_rank", "word_id")
    return matches.unionByName(unknown).withColumn("ix", (F.row_number().over(order) - 1).cast("long"))


def reachable_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes whose start some path from the beginning reaches: a fold over each sentence's starts in order."""
    spans = nodes.groupBy(*SENT).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    zero = F.array(F.lit(0).cast("long"))
    reached = F.aggregate("spans", zero, lambda acc, s: F.when(F.array_contains(acc, s.start) & ~F.array_contains(acc, s.end), F.concat(acc, F.array(s.end))).otherwise(acc))
    starts = spans.select(*SENT, F.explode(reached).alias("start"))
    return nodes.join(starts, [*SENT, "start"], "left_semi")


def lattice_edges(nodes: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, at, right_id, left_id): every adjacent pair of reachable nodes, with the pairs to BOS and EOS (id 0)."""
    ends = nodes.select(*SENT, F.col("end").alias("at"), "right_id").unionAll(sentences.where("text <> ''").select(*SENT, F.lit(0).cast("long"), F.lit(0)))
    starts = nodes.select(*SENT, F.col("start").alias("at"), "left_id").unionAll(sentences.where("text <> ''").select(*SENT, F.length("text").cast("long"), F.lit(0)))
    return ends.join(starts, [*SENT, "at"])


def connid_counts(edges: DataFrame) -> DataFrame:
    """(side, id, cnt) over all pairs."""
    both = edges.select(F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_id").alias("id")), F.struct(F.lit("right").alias("side"), F.col("right_id").alias("id")))).alias("c"))
    return both.groupBy("c.side", "c.id").agg(F.count("*").alias("cnt"))


def connid_probs(counts: DataFrame, num_left: int, num_right: int) -> DataFrame:
    """(side, id, prob, rank): shares of each side's total, id 0 counted but not returned, ids without a count at 0, by falling share."""
    spark = counts.sparkSession
    ids = spark.range(num_left).select(F.lit("left").alias("side"), F.col("id").cast("int").alias("id")).unionAll(spark.range(num_right).select(F.lit("right"), F.col("id").cast("int")))
    rows = ids.join(counts, ["side", "id"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    rows = rows.withColumn("prob", F.try_divide(F.col("cnt").cast("double"), F.sum("cnt").over(Window.partitionBy("side")))).where("id <> 0")
    return rows.select("side", "id", "prob", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("prob"), "id")).cast("long").alias("rank"))
