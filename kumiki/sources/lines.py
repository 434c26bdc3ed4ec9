"""Definition files as DataFrames of numbered lines, and the parsers of single lines that a driver needs."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFormat

CELL = r'(?:"((?:[^"]|"")*)"|([^,"]*))'
MAX_CATEGORIES = 18


def from_text(spark: SparkSession, text: str | Iterable[str]) -> DataFrame:
    """(line_no, value) of given lines."""
    lines = text.splitlines() if isinstance(text, str) else list(text)
    return spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "line_no long, value string")


def from_path(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a definition file, or of the parts of one in order of their names.

    Files are read in splits; a line's number rises with its place in the file, and with the sizes of the files before.
    """
    from pyspark.sql import Window

    text = spark.read.text(path)
    rows = text.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    files = sorted(text.inputFiles())
    if len(files) > 1:
        hadoop, offsets, at = spark.sparkContext._jvm.org.apache.hadoop.fs, [], 0
        for file in files:
            where = hadoop.Path(spark.sparkContext._jvm.java.net.URI(file))
            offsets.append((where.getName(), at))
            at += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen() + 1
        rows = rows.join(F.broadcast(spark.createDataFrame(offsets, "file string, at long")), "file").withColumn("block", F.col("block") + F.col("at"))
    # a line takes a byte at least, so a split's numbers end before the next split's first
    return rows.select((F.col("block") + F.row_number().over(Window.partitionBy("block").orderBy("k")) - 1).cast("long").alias("line_no"), "value")


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(doc_id, sent_id, text): one row for each line of each text."""
    rows = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("sent_id", "text"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_id").cast("long").alias("sent_id"), "text")


def csv_row(text: str) -> list[str]:
    """Cells of a quoted row."""
    return next(csv.reader(io.StringIO(text)), [""])


def cells(row: Column) -> Column:
    """Cells of a quoted row as an array, like ``csv_row``."""
    found = F.regexp_extract_all(F.concat(F.lit(","), row), F.lit(r',("[^"]*(?:""[^"]*)*"|[^,]*)'), 1)
    return F.transform(found, lambda c: F.when(F.startswith(c, F.lit('"')) & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def quote_cell(cell: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if re.search(r'[",\r\n]', cell) else cell


def quoted(cell: Column) -> Column:
    """A cell as CSV needs it."""
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def lexicon(lines: DataFrame) -> DataFrame:
    """(word_id, surface, left_id, right_id, word_cost, feature): four cells, then the rest of the line as it stands.

    Blank lines and empty surfaces are passed over and ids stay dense; a line of
    fewer than five cells, or a number out of range, raises InvalidFormat.
    """
    pattern = f"^{CELL},{CELL},{CELL},{CELL},(.*)$"
    cell = lambda k: F.coalesce(F.nullif(F.replace(F.regexp_extract("value", pattern, 2 * k + 1), F.lit('""'), F.lit('"')), F.lit("")), F.regexp_extract("value", pattern, 2 * k + 2))
    rows = lines.where(F.trim("value") != "").withColumn("ok", F.col("value").rlike(pattern))
    rows = rows.select("line_no", "value", "ok", cell(0).alias("surface"), *[cell(k).try_cast("int").alias(n) for k, n in ((1, "left_id"), (2, "right_id"), (3, "word_cost"))], F.regexp_extract("value", pattern, 9).alias("feature"))
    bad = rows.where(~F.col("ok") | F.coalesce((~F.col("left_id").between(0, 65535)) | (~F.col("right_id").between(0, 65535)) | (~F.col("word_cost").between(-32768, 32767)), F.lit(True))).select("line_no", "value").first()
    if bad:
        raise InvalidFormat(f"lexicon line {bad.line_no}: {bad.value[:80]!r}")
    rows = rows.where("surface <> ''")
    numbered = _before(rows, "line_no", F.lit(1).cast("long"), "word_id")
    return numbered.select("word_id", "surface", "left_id", "right_id", "word_cost", "feature")


def _by_line():
    from pyspark.sql import Window

    return Window.orderBy("line_no")


def matrix(lines: DataFrame) -> tuple[int, int, DataFrame]:
    """num_right, num_left and (right_id, left_id, cost); of repeated cells the last counts, absent ones cost 0."""
    rows = lines.where(F.trim("value") != "")
    head = rows.orderBy("line_no").first()
    cells = head.value.split(" ") if head else []
    if len(cells) != 2 or not all(c.isdigit() for c in cells):
        raise InvalidFormat("matrix header must be: num_right num_left")
    num_right, num_left = map(int, cells)
    part = F.split("value", " ")
    body = rows.where(F.col("line_no") > head.line_no).select("line_no", F.size(part).alias("k"), *[F.get(part, F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(("right_id", "left_id", "cost"))])
    bad = body.where((F.col("k") != 3) | F.coalesce(~(F.col("right_id").between(0, num_right - 1) & F.col("left_id").between(0, num_left - 1) & F.col("cost").between(-32768, 32767)), F.lit(True))).first()
    if bad:
        raise InvalidFormat(f"matrix line {bad.line_no}")
    return num_right, num_left, body.groupBy("right_id", "left_id").agg(F.max_by("cost", "line_no").alias("cost"))


def char_def(lines: Iterable[str]) -> tuple[list[tuple[str, bool, bool, int]], list[tuple[int, int, list[str]]]]:
    """Categories by id (DEFAULT first) and code point ranges in file order; small, so parsed on the driver."""
    ids, ranges = {"DEFAULT": None}, []
    for no, line in enumerate(lines):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        cells = line.split()
        if line.startswith("0x"):
            m = re.fullmatch(r"0x([0-9A-Fa-f]+)(?:\.\.0x([0-9A-Fa-f]+))?", cells[0])
            names = []
            for c in cells[1:]:
                if c.startswith("#"):
                    break
                names.append(c)
            if not m or not names:
                raise InvalidFormat(f"char line {no}: a range and a category are needed")
            lo, hi = int(m[1], 16), int(m[2] or m[1], 16)
            if lo > hi or hi > 0xFFFF:
                raise InvalidFormat(f"char line {no}: bad range")
            ranges.append((lo, hi, names))
        else:
            if len(cells) < 4 or cells[1] not in "01" or cells[2] not in "01" or not cells[3].isdigit() or int(cells[3]) > 15:
                raise InvalidFormat(f"char line {no}: NAME invoke group length")
            ids[cells[0]] = (cells[1] == "1", cells[2] == "1", int(cells[3]))
    if ids["DEFAULT"] is None:
        raise InvalidFormat("category DEFAULT is not defined")
    if len(ids) > MAX_CATEGORIES:
        raise InvalidFormat(f"more than {MAX_CATEGORIES} categories")
    for lo, hi, names in ranges:
        for n in names:
            if n not in ids:
                raise InvalidFormat(f"category {n} is not defined")
    return [(n, *v) for n, v in ids.items()], ranges


def char_tables(spark: SparkSession, lines: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(cate_id, name, invoke, group, length) and (cp, base_id, cate_mask) of every code point up to U+FFFF that a range names."""
    cats, ranges = char_def(lines)
    ids = {c[0]: i for i, c in enumerate(cats)}
    categories = spark.createDataFrame([(i, *c) for i, c in enumerate(cats)], "cate_id int, name string, invoke boolean, group boolean, length int")
    rows = [(k, lo, hi, ids[names[0]], [ids[n] for n in names]) for k, (lo, hi, names) in enumerate(ranges)]
    table = spark.createDataFrame(rows, "k int, lo int, hi int, base_id int, cates array<int>")
    mask = F.aggregate("cates", F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), x)))
    points = table.select(F.explode(F.sequence("lo", "hi")).alias("cp"), "k", "base_id", mask.alias("cate_mask"))
    return categories, points.groupBy("cp").agg(F.max_by("base_id", "k").alias("base_id"), F.max_by("cate_mask", "k").alias("cate_mask"))


def unknowns(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """(unk_id, cate_id, left_id, right_id, word_cost, feature), numbered by category, then file order."""
    from pyspark.sql import Window

    rows = lexicon(lines).join(F.broadcast(categories.select("cate_id", F.col("name").alias("surface"))), "surface", "left")
    if not rows.where("cate_id is null").isEmpty():
        raise InvalidFormat("unknown entry of an undefined category")
    return rows.select((F.row_number().over(Window.orderBy("cate_id", "word_id")) - 1).cast("long").alias("unk_id"), "cate_id", "left_id", "right_id", "word_cost", "feature")


def bigram_features(lines: DataFrame) -> DataFrame:
    """(id, k, feat) of ``id<TAB>csv``; ids must be 1, 2, ... in order, id 0 is all empty."""
    part = F.split("value", "\t")
    rows = lines.where(F.trim("value") != "").select("line_no", F.size(part).alias("w"), F.get(part, F.lit(0)).try_cast("int").alias("id"), F.get(part, F.lit(1)).alias("row"))
    want = rows.withColumn("want", F.row_number().over(_by_line()))
    if not want.where("w <> 2 or id is null or id <> want").isEmpty():
        raise InvalidFormat("bigram features must be numbered 1, 2, ...")
    rows = rows.select("id", F.posexplode(cells(F.col("row"))).alias("k", "feat"))
    zero = rows.groupBy("k").agg(F.lit(0).alias("id"), F.lit("").alias("feat")).select("id", "k", "feat")
    return rows.unionByName(zero)


def bigram_costs(lines: DataFrame) -> DataFrame:
    """(rf, lf, cost) of ``right/left<TAB>cost``; the last of a repeated pair counts."""
    pattern = r"^([^/\t]*)/([^/\t]*)\t(-?[0-9]+)$"
    rows = lines.where(F.trim("value") != "")
    if not rows.where(~F.col("value").rlike(pattern)).isEmpty():
        raise InvalidFormat("bigram costs need right/left<TAB>cost")
    rows = rows.select("line_no", *[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(("rf", "lf", "cost"))])
    return rows.groupBy("rf", "lf").agg(F.max_by(F.col("cost").cast("int"), "line_no").alias("cost"))


def id_order(lines: DataFrame) -> DataFrame:
    """(old_id, new_id): the first cell of line k is the old id of new id k + 1."""
    rows = lines.where(F.trim("value") != "").select("line_no", F.get(F.split("value", "\t"), F.lit(0)).cast("int").alias("old_id"))
    return rows.select("old_id", F.row_number().over(_by_line()).alias("new_id"))


def _before(rows: DataFrame, order: str, value: Column, name: str, width: int = 1 << 16) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of smaller ``order``, in two levels: within ranges of the order and over the ranges."""
    from pyspark.sql import Window

    rows = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / width))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_b").agg(F.sum("_v").alias("_t"))
    ranges = ranges.select("_b", F.coalesce(F.sum("_t").over(ahead(Window.orderBy("_b"))), F.lit(0)).alias("_o"))
    own = F.coalesce(F.sum("_v").over(ahead(Window.partitionBy("_b").orderBy(order))), F.lit(0))
    return rows.join(ranges, "_b").withColumn(name, own + F.col("_o")).drop("_v", "_b", "_o")


def tagged_corpus(lines: DataFrame) -> DataFrame:
    """(example_id, token_pos, surface, feature) of ``surface<TAB>feature`` rows closed by EOS; empty sentences and an unclosed tail are left out."""
    from pyspark.sql import Window

    rows = lines.withColumn("eos", F.col("value") == "EOS")
    if not rows.where("not eos and value <> '' and size(split(value, '\t')) <> 2").isEmpty():
        raise InvalidFormat("corpus rows are surface<TAB>feature or EOS")
    closed = rows.where("eos").count()
    rows = _before(rows, "line_no", F.col("eos").cast("long"), "s").where(~F.col("eos") & (F.col("value") != "") & (F.col("s") < closed))
    examples = _before(rows.select("s").distinct(), "s", F.lit(1).cast("long"), "example_id")
    part = F.split("value", "\t")
    place = F.row_number().over(Window.partitionBy("s").orderBy("line_no")) - 1
    return rows.join(examples, "s").select("example_id", place.cast("long").alias("token_pos"), part[0].alias("surface"), part[1].alias("feature"))


def order_lines(probs: DataFrame, side: str) -> DataFrame:
    """(line_no, value) of a mapping file: ``id<TAB>share`` of ``connid_probs`` rows, falling shares first; ``id_order`` reads it."""
    return probs.where(F.col("side") == side).select((F.col("rank") - 1).alias("line_no"), F.concat_ws("\t", F.col("id").cast("string"), F.col("prob").cast("string")).alias("value"))


def scraped(lines: DataFrame) -> DataFrame:
    """(line_no, value): the first four cells, the cells 4 to 7 other than ``*`` joined by a hyphen, and cell 13, empty if missing or ``*``."""
    c = cells(F.col("value"))
    some = F.array_join(F.filter(F.slice(c, 5, 4), lambda x: x != "*"), "-")
    last = F.coalesce(F.nullif(F.get(c, F.lit(13)), F.lit("*")), F.lit(""))
    return lines.where("value <> ''").select("line_no", F.array_join(F.transform(F.concat(F.slice(c, 1, 4), F.array(some, last)), quoted), ",").alias("value"))


def id_features(lines: DataFrame, templates: list[Callable[[list[str]], str | None]]) -> dict[int, list[str | None]]:
    """Features of ``id<SPACE>row`` lines by id, a few thousand, by the templates; id 0 must be BOS/EOS and no id may miss."""
    out = {}
    for r in lines.where("value <> ''").collect():
        m = re.fullmatch(r"([0-9]+) (.*)", r.value)
        if not m:
            raise InvalidFormat(f"line {r.line_no}: an id and features are needed")
        row = csv_row(m[2])
        if m[1] == "0" and row[0] != "BOS/EOS":
            raise InvalidFormat("id 0 must be BOS/EOS")
        out[int(m[1])] = [t(row) for t in templates]
    if sorted(out) != list(range(len(out))):
        raise InvalidFormat("ids must be 0, 1, 2, ...")
    return out


def text_model(spark: SparkSession, features: Iterable[str], right_ids: DataFrame, left_ids: DataFrame, model: DataFrame, factor: float) -> tuple[list[str], list[str], DataFrame]:
    """Bigram files of an external text model: lines of the right and of the left features, and (line_no, value) of the costs.

    Features are numbered by template and value; pairs of which one side occurs in no id are left out.
    """
    from ..functions.rewriting import Template

    _, pairs = feature_def(features)
    number: list[dict[str, int]] = [{}, {}]
    text = []
    for side, (lines, kind) in enumerate(((right_ids, "L"), (left_ids, "R"))):
        rows = id_features(lines, [Template(p[side], kind) for p in pairs])
        name = lambda f: "*" if f is None else str(number[side].setdefault(f, len(number[side]) + 1))  # noqa: B023, E731
        text.append([f"{i}\t" + ",".join([name(f) for f in rows[i]]) for i in sorted(rows) if i])
    costs = text_model_costs(model, factor).select(F.split("feature", "/").alias("f"), "cost").where("size(f) >= 2")
    for k, c in enumerate("rl"):
        ids = spark.createDataFrame([("", ""), *((f, str(i)) for f, i in number[k].items())], f"f{c} string, {c} string")
        costs = costs.withColumn(f"f{c}", F.get("f", F.lit(k))).join(ids, f"f{c}")
    value = F.concat("r", F.lit("/"), "l", F.lit("\t"), F.col("cost").cast("string"))
    return text[0], text[1], costs.select(F.lit(0).cast("long").alias("line_no"), value.alias("value"))


def text_model_costs(model: DataFrame, factor: float) -> DataFrame:
    """(feature, cost) of ``weight<TAB>feature`` rows: cost is the whole part of -weight * factor, zeros dropped, BOS/EOS as the empty string."""
    pattern = r"^(-?[0-9.eE+-]+)\t(.*)$"
    rows = model.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).cast("double").alias("w"), F.regexp_replace(F.regexp_extract("value", pattern, 2), "BOS/EOS", "").alias("feature"))
    return rows.select("feature", (-F.col("w") * factor).cast("int").alias("cost")).where("cost <> 0")


def feature_def(lines: Iterable[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """UNIGRAM templates and BIGRAM left/right template pairs."""
    uni, bi = [], []
    for no, line in enumerate(lines):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        kind, _, body = line.partition(" ")
        body = body.strip()
        if kind == "UNIGRAM" and body:
            uni.append(body)
        elif kind == "BIGRAM" and body.count("/") == 1:
            left, right = body.split("/")
            bi.append((left, right))
        else:
            raise InvalidFormat(f"feature line {no}: {line!r}")
    return uni, bi


def rewrite_def(lines: Iterable[str]) -> dict[str, list[tuple[list[str], list[str]]]]:
    """Rules of the sections unigram, left and right: a pattern and a rewrite, both CSV."""
    out, section = {"unigram": [], "left": [], "right": []}, None
    for no, line in enumerate(lines):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.fullmatch(r"\[(unigram|left|right) rewrite\]", line)
        if m:
            section = m[1]
            continue
        cells = line.split()
        if section is None or len(cells) != 2:
            raise InvalidFormat(f"rewrite line {no}: {line!r}")
        out[section].append((csv_row(cells[0]), csv_row(cells[1])))
    return out
