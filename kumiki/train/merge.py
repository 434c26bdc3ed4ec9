"""A written model as definition files, by joins: feature rows numbered, costs summed over templates, lines as DataFrames."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lattice as N
from ..plans.dictionary import Dictionary
from ..plans.mapped import shared_dir
from ..shipping import ship
from ..sources.lines import lexicon, quoted

_LABEL = "kind int, id long, head string, feature string, base int, own array<int>"
_SETS = "feature string, base int, uni array<string>, left array<string>, right array<string>"
WORD, UNKNOWN, USER = 0, 1, 2


@dataclass
class Merged:
    """Labels in order with their connection ids and weights, the connection weights of pairs of ids, and the sizes of both sides.

    ``labels`` (label, kind, id, head, feature, own, left_id, right_id, weight), ``pairs`` (row, column, weight): weight of what
    follows ``column`` after ``row``; ``rows`` and ``columns`` (id, k, value) are the feature rows behind the ids.
    """

    labels: DataFrame
    pairs: DataFrame
    rows: DataFrame
    columns: DataFrame
    weights: DataFrame
    num_rows: int
    num_columns: int

    def scale(self) -> DataFrame:
        """One row: 32767 over the largest weight, signs aside."""
        most = F.greatest(F.lit(1e-9), F.max(F.abs("weight")))
        return self.pairs.select("weight").unionAll(self.labels.select("weight")).agg((F.lit(32767.0) / most).alias("scale"))


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that what is made of it several times is not made anew."""
    path = f"{shared_dir(df.sparkSession)}/kumiki/merge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _total(struct: Column) -> Column:
    """The sum of (k, w) pairs in order of k: the same number wherever it is made."""
    return F.aggregate(F.transform(F.array_sort(F.collect_list(struct)), lambda x: x.w), F.lit(0.0), lambda a, x: a + x)


def _labels(d: Dictionary, user: DataFrame | None) -> DataFrame:
    """Words, unknown entries, user rows: each in its own order, one after another, numbered as labels."""
    first = F.ascii(F.substring("surface", 1, 1))
    points = d.points.select(F.col("cp").alias("_cp"), F.col("base_id").alias("base"))
    based = lambda df: df.withColumn("_cp", F.when(first < 65536, first).otherwise(0)).join(F.broadcast(points), "_cp", "left").withColumn("base", F.coalesce("base", F.lit(0)))
    none = F.lit(None).cast("array<int>")
    words = based(d.lexicon).select(F.lit(WORD).alias("kind"), F.col("word_id").alias("id"), F.col("surface").alias("head"), "feature", "base", none.alias("own"))
    names = d.categories.select("cate_id", F.col("name").alias("head"))
    unknown = d.unknown.join(F.broadcast(names), "cate_id").select(F.lit(UNKNOWN).alias("kind"), F.col("unk_id").alias("id"), "head", "feature", F.col("cate_id").alias("base"), none.alias("own"))
    rows = words.unionAll(unknown)
    if user is not None:
        rows = rows.unionAll(based(lexicon(user)).select(F.lit(USER), "word_id", "surface", "feature", "base", F.array("left_id", "right_id", "word_cost")))
    sizes = rows.groupBy("kind").agg((F.max("id") + 1).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("kind", ahead.alias("ahead"))), "kind").select((F.col("id") + F.col("ahead")).alias("label"), "kind", "id", "head", "feature", "base", "own")


def _feature_sets(labels: DataFrame, config: dict) -> DataFrame:
    """The features of each distinct (feature, base category), in Arrow batches."""
    from .crf import FeatureSet

    def run(batches):
        features = FeatureSet(config["unigram"], [tuple(b) for b in config["bigram"]], config["rules"])
        for batch in batches:
            sets = [features(f, b) for f, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[k] for s in sets], pa.list_(pa.string())) for k in range(3))], names=["feature", "base", "uni", "left", "right"])

    return labels.select("feature", "base").distinct().mapInArrow(run, _SETS)


def _numbered(labels: DataFrame, side: str, width: int) -> tuple[DataFrame, DataFrame, int]:
    """((row, id) of the distinct feature rows of a side, (id, k, value) of all ids, number of ids).

    Rows are told apart by their values and numbered 1, 2, ... by the first label that has
    them; id 0 is the edge of a sentence, whose values are empty.
    """
    rows = labels.groupBy(F.col(side).alias("row")).agg(F.min("label").alias("first"))
    rows = _kept(N.numbered(_kept(rows), "first", "id").withColumn("id", F.col("id") + 1))
    edge = F.array(*[F.lit("")] * width).cast("array<string>")
    of = rows.select("row", F.when(F.col("row") == edge, F.lit(0)).otherwise(F.col("id")).alias("id"))
    values = rows.select("id", "row").unionAll(rows.sparkSession.range(1).select(F.lit(0).cast("long"), edge))
    values = values.select("id", F.posexplode("row").alias("k", "value")).where("value IS NOT NULL")
    return of, values, rows.count() + 1


def merged(spark: SparkSession, path: str, user: DataFrame | None = None, pruned: bool = False) -> Merged:
    """A model that ``Model.write`` wrote, with the labels of ``user`` lexicon lines, merged.

    With ``pruned``, values that no weighted pair has are forgotten first, so that rows which differ in them alone share an id.
    """
    ship(spark)
    config = json.loads(spark.read.text(f"{path}/features").first()[0])
    d, width = Dictionary.read(spark, f"{path}/dictionary"), len(config["bigram"])
    named = spark.read.parquet(f"{path}/weights").where("weight <> 0").select(F.from_json("name", "array<string>").alias("n"), "weight")
    single = named.where("n[0] = 'u'").select(F.col("n")[1].alias("x"), F.col("weight").alias("w"))
    pair = named.where("n[0] = 'b'").select(F.col("n")[1].cast("int").alias("k"), F.col("n")[2].alias("a"), F.col("n")[3].alias("b"), F.col("weight").alias("w"))
    labels = _labels(d, user)
    labels = _kept(labels)
    labels = _kept(labels.join(_feature_sets(labels, config), ["feature", "base"]))
    if pruned:
        live = {s: pair.select("k", F.col(c).alias("value")).distinct() for s, c in (("left", "a"), ("right", "b"))}
        for side, used in live.items():
            own = labels.select("label", F.posexplode(side).alias("k", "value")).join(used.withColumn("live", F.lit(True)), ["k", "value"], "left")
            own = own.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("live"), F.col("value")).alias("v")))), lambda x: x.v).alias(side))
            labels = labels.drop(side).join(own, "label")
        labels = _kept(labels)
    left, rows, num_rows = _numbered(labels, "left", width)
    right, columns, num_columns = _numbered(labels, "right", width)
    scored = labels.select("label", F.posexplode("uni").alias("k", "x")).join(single, "x").groupBy("label").agg(_total(F.struct("k", "w")).alias("weight"))
    labels = labels.join(left.select(F.col("row").alias("left"), F.col("id").alias("row_id")), "left").join(right.select(F.col("row").alias("right"), F.col("id").alias("column_id")), "right")
    labels = labels.join(scored, "label", "left").select("label", "kind", "id", "head", "feature", "own", F.col("column_id").alias("left_id"), F.col("row_id").alias("right_id"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    met = rows.select(F.col("id").alias("row"), "k", F.col("value").alias("a")).join(pair, ["k", "a"]).join(columns.select(F.col("id").alias("column"), "k", F.col("value").alias("b")), ["k", "b"])
    pairs = met.groupBy("row", "column").agg(_total(F.struct("k", "w")).alias("weight"))
    return Merged(_kept(labels), _kept(pairs), rows, columns, pair, num_rows, num_columns)


def _cost(weight: Column) -> Column:
    """The whole part of -weight * scale, within 16 bits."""
    return F.least(F.greatest((-weight * F.col("scale")).cast("long"), F.lit(-32768)), F.lit(32767))


def definition_lines(m: Merged) -> dict[str, DataFrame]:
    """lexicon, unknown, user and matrix as (line_no, value); what ``Model.export`` gives as texts.

    A user row keeps its ids and cost unless all three are 0.
    """
    scale = F.broadcast(m.scale())
    own = F.when(F.exists(F.coalesce("own", F.array().cast("array<int>")), lambda x: x != 0), F.transform("own", lambda x: x.cast("string")))
    made = F.array(F.col("left_id").cast("string"), F.col("right_id").cast("string"), _cost(F.col("weight")).cast("string"))
    lines = m.labels.join(scale).select("kind", F.col("id").alias("line_no"), F.array_join(F.concat(F.array(quoted(F.col("head"))), F.coalesce(own, made), F.array("feature")), ",").alias("value"))
    out = {name: lines.where(F.col("kind") == kind).select("line_no", "value") for kind, name in ((WORD, "lexicon"), (UNKNOWN, "unknown"), (USER, "user"))}
    body = m.pairs.join(scale).select("row", "column", _cost(F.col("weight")).alias("cost")).where("cost <> 0")
    head = m.labels.sparkSession.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(f"{m.num_rows} {m.num_columns}").alias("value"))
    out["matrix"] = head.unionAll(body.select((1 + F.col("row") * m.num_columns + F.col("column")).cast("long"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("row", "column", "cost")])))
    return out


def bigram_lines(m: Merged) -> dict[str, DataFrame]:
    """right, left and cost as (line_no, value); what ``Model.export_bigrams`` gives as texts, costs in any order."""

    def said(k: Column, value: Column) -> Column:
        return F.when(value == "", "").otherwise(F.concat(k.cast("string"), F.lit(":"), value))

    def rows(df: DataFrame) -> DataFrame:
        wide = df.where("id > 0").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("v"))
        ids = df.select("id").where("id > 0").distinct().join(wide, "id", "left")
        width = df.agg(F.max("k")).first()[0] + 1
        cell = [F.coalesce(quoted(said(F.lit(k), F.col("v")[k])), F.lit("*")) for k in range(width)]
        return ids.select((F.col("id") - 1).alias("line_no"), F.concat(F.col("id").cast("string"), F.lit("\t"), F.concat_ws(",", *cell)).alias("value"))

    cost = m.weights.where("a <> '' OR b <> ''").join(F.broadcast(m.scale())).withColumn("cost", (-F.col("w") * F.col("scale")).cast("long")).where("cost <> 0")
    value = F.concat(said(F.col("k"), F.col("a")), F.lit("/"), said(F.col("k"), F.col("b")), F.lit("\t"), F.col("cost").cast("string"))
    return {"right": rows(m.rows), "left": rows(m.columns), "cost": cost.select(F.lit(0).cast("long").alias("line_no"), value.alias("value"))}
