"""Reading input tables and cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: While a table is written: shuffle files go when the execution that made them ends, as kept tables are read from the shared
#: folder; small shuffle partitions are merged up to the advisory size, so that small tables are few files.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
#: Shuffle partitions that one task of a table of narrow rows writes.
_NARROW = 8
_KEPT: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, read by Spark alone so that any store it can open will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets one of its own; a cluster's session must name it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='kumiki-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut of lineage that outlives any executor.

    Rows of a few numbers that come out of a shuffle are ``narrow``: fewer tasks write them, in fewer files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / _NARROW)))
    path = f"{shared_dir(spark)}/kumiki/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    _KEPT.append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._kept)


def kept() -> int:
    """How many tables ``keep`` has written: a mark for ``drop_since``."""
    return len(_KEPT)


def drop_since(spark: SparkSession, mark: int, *but: DataFrame) -> None:
    """Delete the tables kept since ``mark``, except those that are still read."""
    stay = {df._kept for df in but}
    for path in [p for p in _KEPT[mark:] if p not in stay]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each lengthened until no column of ``docs`` has it (case counts no more than it does in Spark)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, null texts empty; other columns, clashing names included, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
