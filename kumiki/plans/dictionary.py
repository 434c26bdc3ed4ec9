"""A dictionary: its tables, and the compact form that tasks get for the fold."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidFormat
from ..operators import connectors as C
from ..operators import lattice as N
from ..operators.batch import Index, fence
from ..sources import lines as L
from .mapped import Mapped

VERSION = 2
#: Cells of a dense matrix that may be broadcast, two bytes each; beyond it the feature templates are used, or the load refused.
MATRIX_CELLS = 256_000_000
#: Words that may be broadcast.
LEXICON_WORDS = 8_000_000
#: Words, and cells of a matrix, up to which tasks get a dictionary as a broadcast; a larger one is mapped from files.
SMALL_WORDS, SMALL_CELLS = 50_000, 4_000_000
#: Rows of a factored matrix that a task holds.
HELD_ROWS = 1024


class Dictionary:
    """Tables lexicon, user (or None), categories, points, unknown, costs, with the numbers of connection ids.

    ``factors`` (right, left, pair, raw templates) are the feature templates whose sums the costs are, if known.
    """

    def __init__(self, lexicon: DataFrame, categories: DataFrame, points: DataFrame, unknown: DataFrame, costs: DataFrame, num_right: int, num_left: int, user: DataFrame | None = None, mapping: tuple[DataFrame, DataFrame] | None = None, factors: tuple | None = None):
        self.lexicon, self.categories, self.points, self.unknown, self.costs = lexicon, categories, points, unknown, costs
        self.num_right, self.num_left, self.user, self.mapping, self.factors = num_right, num_left, user, mapping, factors
        self._packed: dict[tuple, "Compact | Mapped"] = {}

    @classmethod
    def from_lines(cls, spark: SparkSession, lexicon, char, unk, matrix=None, bigram=None, dual: bool = False) -> "Dictionary":
        """From the texts (or line lists) of definition files; either ``matrix`` or ``bigram`` = (right, left, cost)."""
        text = lambda x: L.from_text(spark, x)
        return cls.from_frames(spark, text(lexicon), char.splitlines() if isinstance(char, str) else char, text(unk), None if matrix is None else text(matrix), None if bigram is None else [text(x) for x in bigram], dual)

    @classmethod
    def from_paths(cls, spark: SparkSession, lexicon: str, char: str, unk: str, matrix: str | None = None, bigram: tuple[str, str, str] | None = None, dual: bool = False) -> "Dictionary":
        """From the paths of definition files, read in splits."""
        read = lambda path: L.from_path(spark, path)
        return cls.from_frames(spark, read(lexicon), [r.value for r in read(char).orderBy("line_no").collect()], read(unk), None if matrix is None else read(matrix), None if bigram is None else [read(x) for x in bigram], dual)

    @classmethod
    def from_frames(cls, spark: SparkSession, lexicon: DataFrame, char: list[str], unk: DataFrame, matrix: DataFrame | None = None, bigram: tuple[DataFrame, DataFrame, DataFrame] | None = None, dual: bool = False) -> "Dictionary":
        """From (line_no, value) rows; the few lines of the character file as a list."""
        categories, points = L.char_tables(spark, char)
        factors = None
        if matrix is not None:
            num_right, num_left, costs = L.matrix(matrix)
        elif bigram is not None:
            right, left, pair = L.bigram_features(bigram[0]), L.bigram_features(bigram[1]), L.bigram_costs(bigram[2])
            num_right, num_left = (df.agg(F.max("id")).first()[0] + 1 for df in (right, left))
            raw = C.split_templates(right, left) if dual else None
            costs = C.dual_matrix(right, left, pair, raw) if dual else C.summed(right, left, pair).withColumn("cost", F.col("cost").cast("int"))
            factors = right, left, pair, raw
        else:
            raise InvalidArgument("a matrix or bigram files are needed")
        return cls(L.lexicon(lexicon), categories, points, L.unknowns(unk, categories), costs, num_right, num_left, factors=factors).check()

    def check(self) -> "Dictionary":
        """Every connection id must be known to the matrix."""
        for name, df in (("lexicon", self.lexicon), ("unknown", self.unknown), ("user", self.user)):
            if df is not None and not N.unknown_ids(df, self.num_left, self.num_right).isEmpty():
                raise InvalidArgument(f"{name} has a connection id that the matrix has not")
        return self

    def with_user(self, lines: DataFrame | None) -> "Dictionary":
        """Another user lexicon, or none; ids are checked, then remapped as the dictionary's were."""
        user = L.lexicon(lines) if lines is not None else None
        new = Dictionary(self.lexicon, self.categories, self.points, self.unknown, self.costs, self.num_right, self.num_left, user, self.mapping, self.factors).check()
        if user is not None and self.mapping:
            new.user = C.remap(user, *self.mapping)
        return new

    def mapped(self, left: DataFrame, right: DataFrame) -> "Dictionary":
        """Connection ids renamed by ``order`` tables (old_id, new_id); spans, words and costs of results do not change."""
        left, right = C.permutation(left, self.num_left), C.permutation(right, self.num_right)
        both = (C.compose(self.mapping[0], left), C.compose(self.mapping[1], right)) if self.mapping else (left, right)
        r = lambda df: C.remap(df, left, right) if df is not None else None
        ids = lambda df, order: df.join(order.select(F.col("old_id").alias("id"), "new_id"), "id").select(F.col("new_id").alias("id"), "k", "feat")
        factors = (ids(self.factors[0], right), ids(self.factors[1], left), *self.factors[2:]) if self.factors else None
        return Dictionary(r(self.lexicon), self.categories, self.points, r(self.unknown), r(self.costs), self.num_right, self.num_left, r(self.user), both, factors)

    def words(self) -> DataFrame:
        """System and user words with lex_rank."""
        rows = self.lexicon.withColumn("lex_rank", F.lit(1))
        return rows if self.user is None else rows.unionByName(self.user.withColumn("lex_rank", F.lit(0)))

    def features(self) -> DataFrame:
        """(lex_rank, word_id, feature) of all words, unknown ones included."""
        return self.words().select("lex_rank", "word_id", "feature").unionAll(self.unknown.select(F.lit(2), F.col("unk_id"), "feature"))

    def postings(self) -> DataFrame:
        """(surface, word_ids) of the system words."""
        return N.postings(self.lexicon)

    def write(self, path: str) -> None:
        """As Parquet tables in a new folder: lexica, categories, costs, the mapping of ids and the factors."""
        tables = {n: getattr(self, n) for n in ("lexicon", "categories", "points", "unknown", "costs", "user")}
        tables |= dict(zip(("mapping_left", "mapping_right"), self.mapping or ())) | dict(zip(("factor_right", "factor_left", "factor_pair"), self.factors or ()))
        for name, df in tables.items():
            if df is not None:
                df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        held = sorted(n for n, df in tables.items() if df is not None)
        meta = json.dumps({"version": VERSION, "num_right": self.num_right, "num_left": self.num_left, "tables": held, "raw": self.factors[3] if self.factors else None})
        self.lexicon.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Dictionary":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta["version"] != VERSION:
            raise InvalidFormat("another version of the dictionary format")
        t = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
        mapping = (t["mapping_left"], t["mapping_right"]) if "mapping_left" in t else None
        factors = (t["factor_right"], t["factor_left"], t["factor_pair"], meta["raw"]) if "factor_pair" in t else None
        return cls(t["lexicon"], t["categories"], t["points"], t["unknown"], t["costs"], meta["num_right"], meta["num_left"], t.get("user"), mapping, factors)

    def packed(self, mapped: bool | None = None, scorer: bool | None = None) -> "Compact | Mapped":
        """What tasks get, made once: plain Python for a small dictionary, else files that a machine's workers map, of any size.

        With ``scorer``, connection costs are summed from feature pairs when they are asked, not held as a
        matrix; by itself that is so for a matrix of over MATRIX_CELLS cells.
        """
        cells = self.num_right * self.num_left
        if scorer is None:
            scorer = bool(self.factors) and cells > MATRIX_CELLS
        if mapped is None:
            mapped = cells > SMALL_CELLS or self.words().limit(SMALL_WORDS + 1).count() > SMALL_WORDS
        if scorer and not self.factors:
            raise InvalidArgument("summing costs needs the feature templates")
        if (mapped, scorer) not in self._packed:
            self._packed[mapped, scorer] = Mapped.of(self, scorer) if mapped else self.compact()
        return self._packed[mapped, scorer]

    def compact(self) -> "Compact":
        if self.num_right * self.num_left > MATRIX_CELLS and not self.factors:
            raise InvalidArgument(f"a matrix of {self.num_right} x {self.num_left} is too large to broadcast")
        if (many := self.lexicon.count()) > LEXICON_WORDS:
            raise InvalidArgument(f"a lexicon of {many} words is too large to broadcast")
        return Compact(self)


class Factored:
    """Rows of connection costs by left id, summed from the templates when they are first asked for."""

    def __init__(self, num_right: int, right: dict[int, dict[str, list[int]]], left: dict[int, dict[int, str]], pair: dict[str, dict[str, int]], raw: list[int] | None):
        self.num_right, self.left, self.pair, self.raw = num_right, left, pair, raw
        self.right = {k: {f: np.array(ids, dtype=np.int64) for f, ids in feats.items()} for k, feats in right.items()}
        self.held: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, d: Dictionary) -> "Factored":
        rights, lefts, pairs, raw = d.factors
        right: dict[int, dict[str, list[int]]] = {}
        left: dict[int, dict[int, str]] = {}
        pair: dict[str, dict[str, int]] = {}
        for r in rights.toLocalIterator():
            right.setdefault(r.k, {}).setdefault(r.feat, []).append(r.id)
        for r in lefts.toLocalIterator():
            left.setdefault(r.id, {})[r.k] = r.feat
        for r in pairs.toLocalIterator():
            pair.setdefault(r.lf, {})[r.rf] = r.cost
        return cls(d.num_right, right, left, pair, raw)

    def __getitem__(self, left_id: int) -> np.ndarray:
        row = self.held.get(left_id)
        if row is None:
            if len(self.held) >= HELD_ROWS:
                self.held.pop(next(iter(self.held)))
            row = self.held[left_id] = self._row(left_id)
        return row

    def _row(self, left_id: int) -> np.ndarray:
        dense, own = np.zeros(self.num_right, dtype=np.int64), np.zeros(self.num_right, dtype=np.int64)
        for k, feat in self.left.get(left_id, {}).items():
            ids, costs = self.right.get(k, {}), self.pair.get(feat, {})
            into = own if self.raw is None or k in self.raw else dense
            for rf in ids.keys() & costs.keys():
                into[ids[rf]] += costs[rf]
        return own + np.clip(dense, -32768, 32767)


def _cost_rows(num_right: int):
    """(left_id, row) of cost rows sorted by left id: 16-bit costs of all right ids, as bytes."""

    def run(batches):
        at, row = None, None
        for batch in batches:
            left, right, cost = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i in np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1]))).tolist() if len(left) else []:
                end = int(np.searchsorted(left, left[i], side="right"))
                if left[i] != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"left_id": pa.array([at], pa.int32()), "row": pa.array([row.tobytes()], pa.binary())})
                    at, row = int(left[i]), np.zeros(num_right, dtype=np.int32)
                row[right[i:end]] = cost[i:end]
        if at is not None:
            yield pa.RecordBatch.from_pydict({"left_id": pa.array([at], pa.int32()), "row": pa.array([row.tobytes()], pa.binary())})

    return run


class Compact:
    """The dictionary as plain Python and numpy, for the fold of a task."""

    def __init__(self, d: Dictionary):
        self.words: dict[str, list[tuple[int, int, int, int, int]]] = {}
        for r in d.words().select("surface", "lex_rank", "word_id", "left_id", "right_id", "word_cost").orderBy("lex_rank", "word_id").toLocalIterator():
            self.words.setdefault(r.surface, []).append((r.lex_rank, r.word_id, r.left_id, r.right_id, r.word_cost))
        self.starts: dict[str, list[int]] = {}
        for s in self.words:
            self.starts.setdefault(s[0], []).append(len(s))
        self.starts = {c: sorted(set(n)) for c, n in self.starts.items()}
        self.user = any(e[0] == 0 for v in self.words.values() for e in v)
        self.categories = {r.cate_id: (r.invoke, r.group, r.length) for r in d.categories.collect()}
        self.names = {r.name: r.cate_id for r in d.categories.collect()}
        self.points = {r.cp: (r.base_id, r.cate_mask) for r in d.points.toLocalIterator()}
        self.unknown: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for r in d.unknown.orderBy("unk_id").collect():
            self.unknown.setdefault(r.cate_id, []).append((2, r.unk_id, r.left_id, r.right_id, r.word_cost))
        if d.num_left * d.num_right > MATRIX_CELLS:
            self.cost = Factored.of(d)
            return
        rows = d.costs.select("left_id", "right_id", "cost").repartition("left_id").sortWithinPartitions("left_id").mapInArrow(_cost_rows(d.num_right), "left_id int, row binary")
        cost = np.zeros((d.num_left, d.num_right), dtype=np.int16)
        for r in rows.toLocalIterator():
            row = np.frombuffer(r.row, np.int32)
            if len(row) and (row.min() < -32768 or row.max() > 32767):
                cost = cost.astype(np.int32)
            cost[r.left_id] = row
        self.cost = cost.tolist() if cost.size <= 4_000_000 else cost

    def open(self) -> Index:
        """The dictionary's arrays, made once in each worker."""
        if getattr(self, "index", None) is None:
            self.index = Index(self)
        return self.index

    @property
    def fence(self) -> tuple[int, str | None] | None:
        return fence(self.open())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def info(self, ch: str) -> tuple[int, int]:
        cp = ord(ch)
        return self.points.get(cp if cp < 65536 else 0, (0, 1))
