"""Training costs on a tagged corpus: a conditional random field over lattices, its gradient computed in tasks."""

from __future__ import annotations

import itertools
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidFormat
from ..functions.rewriting import Rewriter, Template
from ..operators import viterbi as V
from ..plans.dictionary import Dictionary
from ..plans.mapped import shared_dir
from ..shipping import ship
from ..sources.lines import csv_row, lexicon, quote_cell
from .owlqn import minimise


class FeatureSet:
    """Unigram, left and right feature strings of a label, by templates after rewriting."""

    def __init__(self, unigram: list[str], bigram: list[tuple[str, str]], rules: dict | None = None):
        self.config = {"unigram": unigram, "bigram": [list(b) for b in bigram], "rules": rules}
        self.uni = [Template(t, "F") for t in unigram]
        self.left, self.right = [Template(a, "L") for a, _ in bigram], [Template(b, "R") for _, b in bigram]
        self.rules = {k: Rewriter(v) for k, v in (rules or {}).items()}

    def __call__(self, feature: str, category: int) -> tuple[list[str], list[str | None], list[str | None]]:
        cells = csv_row(feature)
        own = {k: (self.rules[k](cells) or cells) if k in self.rules else cells for k in ("unigram", "left", "right")}
        return [x for t in self.uni if (x := t(own["unigram"], category)) is not None], [t(own["left"]) for t in self.left], [t(own["right"]) for t in self.right]


class _Pairs(dict):
    """Feature numbers of a right row after a left row, put together when first asked for."""

    def __init__(self, lefts, rights, names):
        self.lefts, self.rights, self.names = lefts, rights, names

    def __missing__(self, key):
        keys = [("b", k, a, b) for k, (a, b) in enumerate(zip(self.lefts[key[0]], self.rights[key[1]])) if a is not None and b is not None]
        self[key] = out = [self.names[k] for k in keys if k in self.names]
        return out

    def __reduce__(self):
        return _Pairs, (self.lefts, self.rights, self.names)


class Model:
    """Labels (lexicon words, then unknown entries, then user words), their features and the weights of features."""

    def __init__(self, dictionary: Dictionary, features: FeatureSet):
        self.dictionary, self.compact, self.features = dictionary, dictionary.compact(), features
        words = dictionary.lexicon.orderBy("word_id").collect()
        unk = dictionary.unknown.orderBy("unk_id").collect()
        self.labels = [(1, r.word_id, r.feature, self.compact.info(r.surface[0])[0]) for r in words] + [(2, r.unk_id, r.feature, r.cate_id) for r in unk]
        self.label_of = {(rank, k): i for i, (rank, k, _, _) in enumerate(self.labels)}
        self.by_word = {(r.feature, r.surface[0]): (1, r.word_id) for r in words}  # words of one feature and first character share the last one's label
        self.surfaces = {(1, r.word_id): r.surface for r in words}
        self.user: list[tuple] = []
        sets = [features(f, c) for _, _, f, c in self.labels]
        self.names: dict[tuple, int] = {}
        name = lambda *k: self.names.setdefault(k, len(self.names))
        self.uni = [[name("u", x) for x in u] for u, _, _ in sets]
        edge = ([""] * len(features.left), [""] * len(features.right))
        left, right = [tuple(s[1]) for s in sets], [tuple(s[2]) for s in sets]
        self.lefts, self.rights = [tuple(edge[0]), *dict.fromkeys(left)], [tuple(edge[1]), *dict.fromkeys(right)]
        at = [{row: i for i, row in reversed(list(enumerate(rows)))} for rows in (self.lefts, self.rights)]
        self.left_id, self.right_id = [at[0][x] for x in left], [at[1][x] for x in right]
        for k in range(len(features.left)):  # values that meet in a template, not rows
            for a in dict.fromkeys(row[k] for row in self.lefts if row[k] is not None):
                for b in dict.fromkeys(row[k] for row in self.rights if row[k] is not None):
                    name("b", k, a, b)
        self.pair = _Pairs(self.lefts, self.rights, self.names)
        self.w = np.zeros(len(self.names))

    def add_user(self, lines: DataFrame) -> "Model":
        """Labels for the rows of a user lexicon; features that training never saw have no weight, new rows of features get ids of their own."""
        for r in lexicon(lines).orderBy("word_id").collect():
            uni, left, right = self.features(r.feature, self.compact.info(r.surface[0])[0])
            for rows, row, ids in ((self.lefts, tuple(left), self.left_id), (self.rights, tuple(right), self.right_id)):
                if row not in rows:
                    rows.append(row)
                ids.append(rows.index(row))
            self.user.append((r.surface, r.left_id, r.right_id, r.word_cost))
            self.labels.append((0, len(self.user) - 1, r.feature, None))
            self.uni.append([self.names[k] for x in uni if (k := ("u", x)) in self.names])
        return self

    def prune(self) -> "Model":
        """Feature values without a weight are forgotten, so that rows which differ in them alone share a connection id."""
        used = {k for k, i in self.names.items() if self.w[i] != 0}
        for side, (rows, ids) in enumerate(((self.lefts, self.left_id), (self.rights, self.right_id))):
            live = {(k[1], k[2 + side]) for k in used if k[0] == "b"}
            short = [tuple(x if (k, x) in live else None for k, x in enumerate(row)) for row in rows]
            short[0] = rows[0]
            kept = [short[0], *dict.fromkeys(short[1:])]
            place = {row: i for i, row in enumerate(kept) if i}
            ids[:] = [place[short[i]] if i else 0 for i in ids]
            rows[:] = kept
        self.pair.clear()
        return self

    def write(self, path: str) -> None:
        """The dictionary, the templates and rules, and the weights that are not 0, in a new folder."""
        spark = self.dictionary.lexicon.sparkSession
        self.dictionary.write(f"{path}/dictionary")
        spark.createDataFrame([(json.dumps(self.features.config),)], "value string").coalesce(1).write.text(f"{path}/features")
        rows = [(json.dumps(k), float(self.w[i])) for k, i in self.names.items() if self.w[i] != 0]
        spark.createDataFrame(rows, "name string, weight double").write.option("compression", "zstd").parquet(f"{path}/weights")

    @classmethod
    def read(cls, spark, path: str) -> "Model":
        config = json.loads(spark.read.text(f"{path}/features").first()[0])
        model = cls(Dictionary.read(spark, f"{path}/dictionary"), FeatureSet(config["unigram"], [tuple(b) for b in config["bigram"]], config["rules"]))
        for r in spark.read.parquet(f"{path}/weights").collect():
            model.w[model.names[tuple(json.loads(r.name))]] = r.weight
        return model

    def example(self, tokens: list[tuple[str, str]]) -> tuple[int, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(length, all edges, gold edges) of a sentence; an edge is (start, end, label).

        A gold token is a lexicon word, else the first compatible unknown entry, else it adds no label.
        """
        text, gold, at, d = "".join(s for s, _ in tokens), [], 0, self.compact
        infos = [d.info(c) for c in text]
        run = V.runs([m for _, m in infos])
        edges = set()
        for i in range(len(text)):
            for end, entries in V.candidates(d, text, i, infos[i][0], run[i], 0):
                edges.update((i, end, self.label_of[e[0], e[1]]) for e in entries if (e[0], e[1]) in self.label_of)
        for surface, feature in tokens:
            key = self.by_word.get((feature, surface[:1]))
            if key is None and surface:
                cells, (base, _) = csv_row(feature), infos[at]
                _, group, length = d.categories[base]
                if group or len(surface) <= min(length, run[at]):
                    for e in d.unknown.get(base, ()):
                        want = csv_row(self.labels[self.label_of[2, e[1]]][2])
                        if all(a in ("*", b) for a, b in zip(want, [*cells, *["*"] * len(want)])):
                            key = (2, e[1])
                            break
            gold.append((at, at + len(surface), -1 if key is None else self.label_of[key]))
            at += len(surface)
        return len(text), sorted(edges | set(gold)), gold

    def score(self, label: int, w) -> float:
        return sum(w[k] for k in self.uni[label]) if label >= 0 else 0.0

    def connect(self, before: int, label: int) -> list[int]:
        """Features of a label (or BOS / EOS: -2) after another; unlabelled tokens connect as those do."""
        return self.pair[self.left_id[before] if before >= 0 else 0, self.right_id[label] if label >= 0 else 0]

    def gradient(self, tokens, w) -> tuple[float, dict[int, float]]:
        """Negative log-likelihood of a sentence and its gradient, by forward-backward over (place, label) states."""
        return self.lattice_gradient(*self.example(tokens), w)

    def lattice_gradient(self, n: int, edges, gold, w) -> tuple[float, dict[int, float]]:
        """The same of a sentence whose lattice is built."""
        fore = {(0, -2): 0.0}
        walk = list(self._ordered(edges, w))
        for start, before, end, label, s in walk:
            key, value = (end, label), fore[start, before] + s
            fore[key] = np.logaddexp(fore[key], value) if key in fore else value
        closing = {k: sum(w[i] for i in self.connect(k[1], -2)) for k in fore if k[0] == n}
        if not closing:
            return 0.0, {}
        z = np.logaddexp.reduce([fore[k] + c for k, c in closing.items()])
        back = dict(closing)
        for start, before, end, label, s in reversed(walk):
            if (end, label) in back:
                value = back[end, label] + s
                key = start, before
                back[key] = np.logaddexp(back[key], value) if key in back else value
        grad: dict[int, float] = {}

        def add(keys, value):
            for k in keys:
                grad[k] = grad.get(k, 0.0) + value

        for start, before, end, label, s in walk:
            if (end, label) in back:
                p = float(np.exp(fore[start, before] + s + back[end, label] - z))
                add(self.connect(before, label), p)
                if label >= 0:
                    add(self.uni[label], p)
        for k, c in closing.items():
            add(self.connect(k[1], -2), float(np.exp(fore[k] + c - z)))
        before, total = -2, 0.0
        for _, _, label in gold:
            keys = [*self.connect(before, label), *(self.uni[label] if label >= 0 else ())]
            total += sum(w[k] for k in keys)
            add(keys, -1.0)
            before = label
        keys = self.connect(before, -2)
        add(keys, -1.0)
        return float(z - total - sum(w[k] for k in keys)), grad

    def _ordered(self, edges, w):
        """Transitions in order of their start place."""
        at: dict[int, set[int]] = {0: {-2}}
        for start, end, label in edges:
            for before in sorted(at.get(start, ())):
                yield start, before, end, label, self.score(label, w) + sum(w[k] for k in self.connect(before, label))
                at.setdefault(end, set()).add(label)

    def _scale(self) -> float:
        conn = (sum(self.w[k] for k in self.pair[r, c]) for r in range(len(self.lefts)) for c in range(len(self.rights)))
        return 32767 / max(1e-9, max(abs(x) for x in itertools.chain(conn, (self.score(i, self.w) for i in range(len(self.labels))))))

    def export(self) -> dict[str, str]:
        """lexicon, matrix, unknown and user texts: costs are the whole part of -weight * 32767 / max |weight|.

        A user row keeps its ids and cost unless all three are 0.
        """
        scale = self._scale()
        cost = lambda x: max(-32768, min(32767, int(-x * scale)))
        name = {r.cate_id: r.name for r in self.dictionary.categories.collect()}
        # a word's right side (towards what follows) uses its left templates' row, as in training
        ids = lambda i: (self.right_id[i], self.left_id[i], cost(self.score(i, self.w)))
        row = lambda i, head, own: ",".join([quote_cell(head), *map(str, own), self.labels[i][2]])
        of = lambda rank: [(i, k, c) for i, (r, k, _, c) in enumerate(self.labels) if r == rank]
        lex = [row(i, self.surfaces[1, k], ids(i)) for i, k, _ in of(1)]
        unk = [row(i, name[c], ids(i)) for i, _, c in of(2)]
        user = [row(i, self.user[k][0], self.user[k][1:] if any(self.user[k][1:]) else ids(i)) for i, k, _ in of(0)]
        matrix = [f"{len(self.lefts)} {len(self.rights)}"]
        for r in range(len(self.lefts)):
            for c in range(len(self.rights)):
                if v := cost(sum(self.w[k] for k in self.pair[r, c])):
                    matrix.append(f"{r} {c} {v}")
        return {"lexicon": "\n".join(lex), "unknown": "\n".join(unk), "matrix": "\n".join(matrix), "user": "\n".join(user)}

    def export_bigrams(self) -> dict[str, str]:
        """right, left and cost texts of the feature templates: what the matrix sums up, each cost cut to whole numbers.

        Values are named by template, so that equal values of two templates stay apart; the pair of both edges has no cost here.
        """
        scale = self._scale()

        def said(k, x):
            if x and "/" in x:
                raise InvalidFormat(f"a feature with a slash cannot be written: {x!r}")
            return "*" if x is None else f"{k}:{x}" if x else ""

        rows = lambda rows: "\n".join(f"{i}\t" + ",".join(quote_cell(said(k, x)) for k, x in enumerate(row)) for i, row in enumerate(rows) if i)
        costs = [f"{said(n[1], n[2])}/{said(n[1], n[3])}\t{c}" for n, i in self.names.items() if n[0] == "b" and (n[2] or n[3]) and (c := int(-self.w[i] * scale))]
        return {"right": rows(self.lefts), "left": rows(self.rights), "cost": "\n".join(costs)}


def lattices(model: Model, corpus: DataFrame) -> DataFrame:
    """(n, edges, gold) of every sentence of ``corpus(example_id, token_pos, surface, feature)``: its length, all edges and the right ones, as whole numbers."""
    ship(corpus.sparkSession)
    examples = corpus.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("token_pos", "surface", "feature"))).alias("tokens"))
    m = corpus.sparkSession.sparkContext.broadcast(_Plain(model))

    def run(batches):
        for batch in batches:
            found = [Model.example(m.value, [(t["surface"], t["feature"]) for t in tokens]) for tokens in batch.column(0).to_pylist()]
            packed = [pa.array([np.array(f[k], dtype=np.int32).tobytes() for f in found], pa.binary()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), *packed], names=["n", "edges", "gold"])

    return examples.select("tokens").mapInArrow(run, "n int, edges binary, gold binary")


def objective(model, built: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all ``lattices``: tasks add up theirs, features are summed by key."""
    spark = built.sparkSession
    m, shared = spark.sparkContext.broadcast(_Plain(model)), spark.sparkContext.broadcast(w)
    three = lambda b: list(map(tuple, np.frombuffer(b, np.int32).reshape(-1, 3).tolist()))

    def run(batches):
        loss, grad = 0.0, {}
        for batch in batches:
            for n, edges, gold in zip(*(c.to_pylist() for c in batch.columns)):
                value, g = Model.lattice_gradient(m.value, n, three(edges), three(gold), shared.value)
                loss += value
                for k, v in g.items():
                    grad[k] = grad.get(k, 0.0) + v
        grad[-1] = loss
        yield pa.RecordBatch.from_arrays([pa.array(list(grad), pa.int64()), pa.array(list(grad.values()), pa.float64())], names=["k", "v"])

    rows = built.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    k, v = (rows.column(c).to_numpy() for c in ("k", "v"))
    out = np.zeros(len(w))
    out[k[k >= 0]] = v[k >= 0]
    m.destroy()
    shared.destroy()
    return float(v[k < 0].sum()), out


class _Plain(Model):
    """A model without DataFrames, for tasks."""

    def __init__(self, model: Model):
        self.__dict__ = {k: v for k, v in model.__dict__.items() if k not in ("dictionary", "features")}


def train(dictionary: Dictionary, corpus: DataFrame, features: FeatureSet, l1: float = 0.01, max_iter: int = 100) -> Model:
    """Weights with an L1 penalty, by quasi-Newton steps; zero weights carry no cost.

    ``corpus`` has (example_id, token_pos, surface, feature).  Lattices are built once and written
    to the shared folder; every evaluation is one pass over them.  ``passes`` of the model has their number.
    """
    if l1 < 0 or max_iter < 1:
        raise InvalidArgument("l1 must not be negative and max_iter at least 1")
    spark = ship(corpus.sparkSession)
    model, path = Model(dictionary, features), f"{shared_dir(spark)}/kumiki/lattices-{uuid.uuid4().hex}"
    lattices(model, corpus).write.parquet(path)
    built = spark.read.parquet(path)
    model.w, model.passes = minimise(lambda w: objective(model, built, w), model.w, l1, max_iter)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return model
