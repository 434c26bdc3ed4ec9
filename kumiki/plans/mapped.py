"""A dictionary as files of flat arrays that all workers of a machine map into memory.

Executors hash the words and their prefixes, number features and put costs in rows; Spark
sorts them, and they are written as pieces to the shared folder.  The files reach each machine
once; its first worker lays the pieces end to end, and all workers map the result.
"""

from __future__ import annotations

import fcntl
import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators.batch import Index, hashes
from ..operators.pair_cost import PairCosts, pair_keys

#: Words or pairs in one sorted part.
PART_ROWS = 1 << 20
_PIECE = "kind string, seq long, data binary"
_TYPES = {"size": np.int32, "hash": np.uint64, "many": np.int32, "text": np.uint32, "entries": np.int32, "prefix": np.uint64, "depth": np.int32, "keys": np.uint64, "costs": np.int32}
_OPEN: dict[str, Index] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='kumiki-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _rows(kinds: list[str], seqs: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(seqs, pa.int64()), pa.array(data, pa.binary())], names=["kind", "seq", "data"])


def _signed(h: np.ndarray) -> pa.Array:
    """Unsigned numbers as signed ones of the same order."""
    return pa.array((h ^ np.uint64(1 << 63)).view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    surfaces = column.to_pylist()
    size = np.array([len(s) for s in surfaces], dtype=np.int64)
    return np.frombuffer("".join(surfaces).encode("utf-32-le"), dtype=np.uint32), size, np.cumsum(size) - size


def _word_hashes(batches):
    """(surface, entries) with the length and hash of the surface."""
    for batch in batches:
        cps, size, first = _characters(batch.column(0))
        h, live = np.zeros(len(size), dtype=np.uint64), np.arange(len(size))
        for n in range(1, int(size.max(initial=0)) + 1):
            live = live[size[live] >= n]
            h[live] = hashes(cps[first[live] + n - 1], h[live])
        yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), _signed(h), *batch.columns], names=["n", "h", *batch.schema.names])


def _prefix_hashes(batches):
    """(n, h) of the proper prefixes of surfaces."""
    for batch in batches:
        cps, size, first = _characters(batch.column(0))
        h, live = np.zeros(len(size), dtype=np.uint64), np.arange(len(size))
        for n in range(1, int(size.max(initial=0))):
            on = size[live] > n
            h, live = hashes(cps[first[live[on]] + n - 1], h[on]), live[on]
            u = np.unique(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), n, dtype=np.int32)), _signed(u)], names=["n", "h"])


def _numbered(pieces):
    """Pieces (name, bytes) of the batches of a sorted part, numbered by part and batch."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(b for b in batches if b.num_rows):
            made = pieces(batch)
            yield _rows([n for n, _ in made], [(part << 32) + k] * len(made), [np.ascontiguousarray(a.astype(_TYPES[n])).tobytes() for n, a in made])

    return run


def _word_pieces(batch):
    cps, size, _ = _characters(batch.column(2))
    lists = batch.column(3)
    fields = lists.flatten()
    entries = np.stack([fields.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
    return [("size", size), ("hash", _unsigned(batch.column(1))), ("many", lists.value_lengths().to_numpy()), ("text", cps), ("entries", entries)]


def _sorted_pieces(df: DataFrame, pieces, *keys: str) -> DataFrame:
    """``df`` in order of its keys as pieces; equal keys stay in one part."""
    parts = max(1, -(-df.count() // PART_ROWS))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_numbered(pieces), _PIECE)


def _row_pieces(name: str):
    """(id, row) to pieces numbered by id."""

    def run(batches):
        for batch in batches:
            yield _rows([name] * batch.num_rows, batch.column(0).to_pylist(), batch.column(1).to_pylist())

    return run


def _cost_rows(num_right: int, kind):
    """(left_id, right_id, cost) sorted by left id to (left_id, row): the costs of all right ids."""

    def run(batches):
        at, row = None, None
        for batch in batches:
            left, right, cost = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i in np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1]))).tolist() if len(left) else []:
                end = int(np.searchsorted(left, left[i], side="right"))
                if left[i] != at:
                    if at is not None:
                        yield _rows(["matrix"], [at], [row.tobytes()])
                    at, row = int(left[i]), np.zeros(num_right, dtype=kind)
                row[right[i:end]] = cost[i:end]
        if at is not None:
            yield _rows(["matrix"], [at], [row.tobytes()])

    return run


def _feature_rows(features: DataFrame, side: str, templates: list[int]) -> DataFrame:
    """Pieces: the numbers of an id's features by template, 0 where it has none."""
    at = {k: i for i, k in enumerate(templates)}

    def run(batches):
        for batch in batches:
            out = []
            for feats in batch.column(1).to_pylist():
                row = np.zeros(len(templates), dtype=np.uint64)
                for f in feats:
                    row[at[f["k"]]] = f["h"] & 0xFFFFFFFFFFFFFFFF or 1
                out.append(row.tobytes())
            yield _rows([side] * len(out), batch.column(0).to_pylist(), out)

    rows = features.where("feat IS NOT NULL").select(F.col("id").cast("long").alias("id"), "k", _feature(side, "feat").alias("h"))
    return rows.groupBy("id").agg(F.collect_list(F.struct("k", "h")).alias("feats")).mapInArrow(run, _PIECE)


def _feature(side: str, column: str):
    return F.xxhash64(F.lit(side), F.col(column))


def _keyed(batches):
    for batch in batches:
        r, l = (np.where(h == 0, np.uint64(1), h) for h in (c.to_numpy().view(np.uint64) for c in batch.columns[:2]))
        yield pa.RecordBatch.from_arrays([_signed(pair_keys(r, l)), batch.column(2)], names=["h", "cost"])


@dataclass
class Mapped:
    """What tasks get of a dictionary: the names of its files and its small tables."""

    name: str
    files: list[str]
    points: np.ndarray
    categories: np.ndarray
    unknown: np.ndarray
    space: int | None
    shapes: dict[str, tuple]
    raw: list[bool] | None = None
    kinds: dict = field(default_factory=dict)
    fence = None  # the driver does not open the files

    @classmethod
    def of(cls, d, scorer: bool) -> "Mapped":
        """Write the pieces of a dictionary and send the files to every machine; ``scorer``: costs are summed from features when asked."""
        spark, name = d.lexicon.sparkSession, f"dictionary-{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/kumiki/{name}"

        def once(df: DataFrame, part: str) -> DataFrame:
            """``df`` written and read back: what is made of it several times is not made anew."""
            df.write.parquet(f"{path}/made/{part}")
            return spark.read.schema(df.schema).parquet(f"{path}/made/{part}")

        entry = F.struct("lex_rank", F.col("word_id").cast("int").alias("word_id"), "left_id", "right_id", "word_cost")
        words = once(d.words().select("surface", entry.alias("e")).groupBy("surface").agg(F.array_sort(F.collect_list("e")).alias("entries")), "entries")
        prefixes = once(words.select("surface").mapInArrow(_prefix_hashes, "n int, h long").distinct(), "prefixes")
        words = once(words.mapInArrow(_word_hashes, "n int, h long, surface string, entries array<struct<lex_rank:int,word_id:int,left_id:int,right_id:int,word_cost:int>>"), "words")
        tables = {"words": _sorted_pieces(words, _word_pieces, "n", "h"), "prefixes": _sorted_pieces(prefixes, lambda b: [("prefix", _unsigned(b.column(1))), ("depth", b.column(0).to_numpy())], "n", "h")}
        shapes, raw = {}, None
        if scorer:
            rights, lefts, pairs, own = d.factors
            templates = sorted(r.k for r in rights.select("k").unionAll(lefts.select("k")).distinct().collect())
            raw = None if own is None else [k in own for k in templates]
            shapes = {"right": (d.num_right, len(templates), "u8"), "left": (d.num_left, len(templates), "u8")}
            keyed = pairs.select(_feature("right", "rf").alias("r"), _feature("left", "lf").alias("l"), "cost").mapInArrow(_keyed, "h long, cost int")
            if not keyed.groupBy("h").count().where("count > 1").isEmpty():
                raise InvalidArgument("two feature pairs share a number")
            tables |= {"right": _feature_rows(rights, "right", templates), "left": _feature_rows(lefts, "left", templates), "pairs": _sorted_pieces(keyed, lambda b: [("keys", _unsigned(b.column(0))), ("costs", b.column(1).to_numpy())], "h")}
        else:
            least, most = d.costs.agg(F.min("cost"), F.max("cost")).first()
            kind = "i2" if least is None or (least >= -32768 and most <= 32767) else "i4"
            shapes = {"matrix": (d.num_left, d.num_right, kind)}
            tables["costs"] = d.costs.select("left_id", "right_id", "cost").repartition("left_id").sortWithinPartitions("left_id").mapInArrow(_cost_rows(d.num_right, kind), _PIECE)
        if not words.groupBy("n", "h").count().where("count > 1").isEmpty():
            raise InvalidArgument("two words share a number")
        files = []
        for part, df in tables.items():
            df.write.parquet(f"{path}/{part}")
            for file in spark.read.parquet(f"{path}/{part}").inputFiles():
                spark.sparkContext.addFile(file)
                files.append(file.rsplit("/", 1)[1])
        made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/made")
        made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(made, True)
        table = lambda df, *columns: np.array([tuple(int(v) for v in r) for r in df.select(*columns).collect()], dtype=np.int64).reshape(-1, len(columns))
        cates = table(d.categories, "cate_id", "invoke", "group", "length")
        categories = np.zeros((int(cates[:, 0].max()) + 1, 3), dtype=np.int64)
        categories[cates[:, 0]] = cates[:, 1:]
        unknown = table(d.unknown.withColumn("two", F.lit(2)).orderBy("cate_id", "unk_id"), "cate_id", "two", "unk_id", "left_id", "right_id", "word_cost")
        space = [r.cate_id for r in d.categories.where("name = 'SPACE'").collect()]
        return cls(name, files, table(d.points, "cp", "base_id", "cate_mask"), categories, unknown, space[0] if space else None, shapes, raw)

    def open(self) -> Index:
        """The dictionary's arrays, mapped from this machine's files; the first worker that comes lays them out."""
        if self.name not in _OPEN:
            _OPEN.clear()  # a worker's earlier dictionary; its maps go with it
            _OPEN[self.name] = self._opened()
        return _OPEN[self.name]

    def _opened(self) -> Index:
        root = SparkFiles.getRootDirectory()
        folder = os.path.join(root, self.name)
        with open(folder + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(folder):
                self._lay_out(root, f"{folder}.made")
                os.rename(f"{folder}.made", folder)
        at = lambda name, kind: np.memmap(path, kind, "r") if os.path.getsize(path := os.path.join(folder, name)) else np.zeros(0, kind)
        a = {name: at(name, kind) for name, kind in _TYPES.items() if os.path.exists(os.path.join(folder, name))}
        ix = Index.__new__(Index)
        ix.entries = a["entries"].reshape(-1, 5)
        size = a["size"].astype(np.int64)
        cut = np.searchsorted(a["depth"], np.arange(1, int(size[-1] if len(size) else 0) + 2))
        ix.set_words(a["text"], size, a["hash"], a["many"].astype(np.int64), [a["prefix"][x:y] for x, y in zip(cut[:-1], cut[1:])])
        ix.set_characters(self.points, self.categories, self.unknown, self.space)
        table = {name: np.memmap(os.path.join(folder, name), kind, "r", shape=(rows, columns)) for name, (rows, columns, kind) in self.shapes.items()}
        ix.cost = table["matrix"] if "matrix" in table else PairCosts(table["right"], table["left"], a["keys"], a["costs"], self.raw)
        return ix

    def _lay_out(self, root: str, folder: str) -> None:
        """Lay the pieces of sorted arrays end to end, in order of their numbers, and put rows in their places; one piece is held at a time."""
        os.makedirs(folder, exist_ok=True)
        places: dict[str, list[tuple[int, str, int, int]]] = {}
        for name, (rows, columns, kind) in self.shapes.items():
            np.memmap(os.path.join(folder, name), kind, "w+", shape=(rows, columns))
        for name in self.files:
            file = pq.ParquetFile(os.path.join(root, name))
            for group in range(file.num_row_groups):
                table = file.read_row_group(group, columns=["kind", "seq"])
                for row, (kind, seq) in enumerate(zip(table.column(0).to_pylist(), table.column(1).to_pylist())):
                    places.setdefault(kind, []).append((seq, name, group, row))
        for kind in (k for k in _TYPES if k not in places):
            open(os.path.join(folder, kind), "wb").close()
        held = None
        for kind, found in places.items():
            with open(os.path.join(folder, kind), "r+b" if kind in self.shapes else "wb") as out:
                for seq, name, group, row in sorted(found):
                    if held is None or held[:2] != (name, group):
                        held = name, group, pq.ParquetFile(os.path.join(root, name)).read_row_group(group, columns=["data"]).column(0)
                    if kind in self.shapes:
                        out.seek(seq * self.shapes[kind][1] * np.dtype(self.shapes[kind][2]).itemsize)
                    out.write(held[2][row].as_py())
