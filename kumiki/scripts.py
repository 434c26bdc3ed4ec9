"""Commands over files: python -m kumiki.scripts COMMAND ...; each reads paths that Spark can open and writes new folders."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lattice as N
from .plans import tokenizer as T
from .plans.dictionary import Dictionary
from .shipping import ship
from .sources import lines as L


def _sentences(spark: SparkSession, path: str) -> DataFrame:
    return L.from_path(spark, path).select(F.lit(0).cast("long").alias("doc_id"), F.col("line_no").alias("sent_id"), F.col("value").alias("text"))


def _dictionary(spark: SparkSession, o) -> Dictionary:
    d = Dictionary.read(spark, o.dictionary)
    return d.with_user(L.from_path(spark, o.user_lexicon)) if getattr(o, "user_lexicon", None) else d


def _lines(rows: DataFrame, path: str, order: str = "line_no") -> None:
    """Text files that together hold the lines in order: ``from_path`` reads the folder as one file."""
    rows.sort(order).select("value").write.text(path)


def tokenize(spark: SparkSession, o) -> None:
    """Sentences, one a line, to tokens: surface and feature lines, words between spaces, or lines with details."""
    t, lines = T.Tokenizer(_dictionary(spark, o), o.ignore_space, o.max_grouping_len), _sentences(spark, o.input)
    tokens = t.transform(lines)
    out = T.wakati(tokens, lines) if o.mode == "wakati" else T.lines_format(t.with_features(tokens), lines, detail=o.mode == "detail")
    out.sort("sent_id").select(F.col("out").alias("value")).write.text(o.output)


def benchmark(spark: SparkSession, o) -> tuple[float, float, float]:
    """Seconds to tokenise all sentences, held in memory: least, mean and most of a trial's runs without the fastest and the slowest, averaged over trials."""
    t, lines = T.Tokenizer(_dictionary(spark, o), o.ignore_space, o.max_grouping_len), _sentences(spark, o.input).persist()
    run = lambda: t.transform(lines).write.format("noop").mode("overwrite").save()
    n = lines.agg(F.count("*"), F.sum(F.length("text"))).first()
    run()
    trials = []
    for _ in range(o.trials):
        took = []
        for _ in range(o.runs):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        took = sorted(took)[1:-1]
        trials.append((took[0], sum(took) / len(took), took[-1]))
    out = tuple(sum(x) / len(x) for x in zip(*trials))
    print(f"Number_of_sentences: {n[0]}\nCharacters: {n[1]}\nElapsed_seconds: [{', '.join(f'{x:.4f}' for x in out)}]")
    lines.unpersist()
    return out


def compile_(spark: SparkSession, o) -> None:
    """Definition files to a dictionary."""
    Dictionary.from_paths(spark, o.lexicon, o.char, o.unknown, o.matrix, tuple(o.bigram) if o.bigram else None, o.dual).write(o.output)


def reorder(spark: SparkSession, o) -> None:
    """Mapping files (OUTPUT.left, OUTPUT.right) by the shares of connection ids in the lattices of sentences."""
    d = _dictionary(spark, o)
    probs = N.connid_probs(T.Tokenizer(d, o.ignore_space, o.max_grouping_len).connid_counts(_sentences(spark, o.input)), d.num_left, d.num_right)
    for side in ("left", "right"):
        _lines(L.order_lines(probs, side), f"{o.output}.{side}")


def map_(spark: SparkSession, o) -> None:
    """A dictionary with its connection ids renamed by mapping files."""
    left, right = (L.id_order(L.from_path(spark, f"{o.mapping}.{side}")) for side in ("left", "right"))
    _dictionary(spark, o).mapped(left, right).write(o.output)


def train(spark: SparkSession, o) -> None:
    """A tagged corpus to a model."""
    from .train.crf import FeatureSet
    from .train.crf import train as fit

    values = lambda path: [r.value for r in L.from_path(spark, path).orderBy("line_no").collect()]
    char, unk = values(o.char), L.from_path(spark, o.unknown).orderBy("line_no")
    d = Dictionary.from_lines(spark, values(o.lexicon), char, [r.value for r in unk.collect()], "1 1\n")
    uni, bi = L.feature_def(values(o.features))
    model = fit(d, L.tagged_corpus(L.from_path(spark, o.corpus)), FeatureSet(uni, bi, L.rewrite_def(values(o.rewrite)) if o.rewrite else None), o.l1, o.max_iter)
    model.write(o.output)


def dictgen(spark: SparkSession, o) -> None:
    """A model to definition files lexicon, unknown, matrix, user, and bigram.right, .left, .cost, in OUTPUT."""
    from .train import merge

    m = merge.merged(spark, o.model, L.from_path(spark, o.user_lexicon) if o.user_lexicon else None, pruned=True)
    lines = merge.definition_lines(m) | ({f"bigram.{k}": v for k, v in merge.bigram_lines(m).items()} if o.bigram else {})
    for name, rows in lines.items():
        _lines(rows, f"{o.output}/{name}")


def smalldic(spark: SparkSession, o) -> None:
    """An external text model (its templates, right and left ids, and weights) with lexicon, character and unknown files to a dictionary of factored costs."""
    values = lambda path: [r.value for r in L.from_path(spark, path).orderBy("line_no").collect()]
    right, left, costs = L.text_model(spark, values(o.features), L.from_path(spark, o.right), L.from_path(spark, o.left), L.from_path(spark, o.model), o.factor)
    Dictionary.from_frames(spark, L.from_path(spark, o.lexicon), values(o.char), L.from_path(spark, o.unknown), bigram=(L.from_text(spark, right), L.from_text(spark, left), costs), dual=o.dual).write(o.output)


def evaluate(spark: SparkSession, o) -> DataFrame:
    """Precision, recall and F1 of the tokenizer on a tagged corpus, printed."""
    corpus = L.tagged_corpus(L.from_path(spark, o.corpus))
    t, lines = T.Tokenizer(_dictionary(spark, o), False, o.max_grouping_len), T.corpus_sentences(corpus)
    out = T.accuracy(T.corpus_spans(corpus, o.cells), t.with_features(t.transform(lines)).withColumn("features", T.picked(F.col("feature"), o.cells)))
    for name, value in out.first().asDict().items():
        print(f"{name} = {value}")
    return out


def split(spark: SparkSession, o) -> None:
    """A tagged corpus to OUTPUT/train, OUTPUT/valid and OUTPUT/test."""
    corpus = L.tagged_corpus(L.from_path(spark, o.corpus))
    parts = T.corpus_split(T.corpus_lines(corpus), "example_id", o.valid, o.test, o.seed)
    for part in ("train", "valid", "test"):
        _lines(parts.where(F.col("part") == part).select("example_id", F.col("out").alias("value")), f"{o.output}/{part}", "example_id")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kumiki.scripts", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *paths, options=()):
        p = sub.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for path in paths:
            p.add_argument(f"--{path.rstrip('?')}", required=not path.endswith("?"))
        for flag, more in options:
            p.add_argument(flag, **more)

    ratio = lambda flag: (flag, {"type": T.ratio, "default": 0.1})
    spaces = [("--ignore-space", {"action": "store_true"}), ("--max-grouping-len", {"type": int, "default": 0})]
    command("tokenize", tokenize, "dictionary", "input", "output", "user-lexicon?", options=[*spaces, ("--mode", {"choices": ("lines", "wakati", "detail"), "default": "lines"})])
    many = lambda flag, least: (flag, {"type": int, "default": 10, "choices": range(least, 1001), "metavar": "N"})
    command("benchmark", benchmark, "dictionary", "input", "user-lexicon?", options=[*spaces, many("--trials", 1), many("--runs", 3)])
    command("compile", compile_, "lexicon", "char", "unknown", "output", "matrix?", options=[("--bigram", {"nargs": 3}), ("--dual", {"action": "store_true"})])
    command("reorder", reorder, "dictionary", "input", "output", options=spaces)
    command("map", map_, "dictionary", "mapping", "output")
    command("train", train, "lexicon", "char", "unknown", "features", "corpus", "output", "rewrite?", options=[("--l1", {"type": float, "default": 0.01}), ("--max-iter", {"type": int, "default": 100})])
    command("dictgen", dictgen, "model", "output", "user-lexicon?", options=[("--bigram", {"action": "store_true"})])
    command("smalldic", smalldic, "features", "right", "left", "model", "lexicon", "char", "unknown", "output", options=[("--factor", {"type": float, "default": 700.0}), ("--dual", {"action": "store_true"})])
    command("evaluate", evaluate, "dictionary", "corpus", "user-lexicon?", options=[spaces[1], ("--cells", {"type": int, "nargs": "*", "default": [0]})])
    command("split", split, "corpus", "output", options=[ratio("--valid"), ratio("--test"), ("--seed", {"type": int, "default": 0})])
    return top


def main(args: list[str] | None = None) -> None:
    o = parser().parse_args(args)
    o.run(ship(SparkSession.builder.getOrCreate()), o)


if __name__ == "__main__":
    main()
