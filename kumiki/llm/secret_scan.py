"""Secrets in texts: fixed patterns and windowed entropy, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free

# Fixed patterns of the base scan.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"  # a whole run of [A-Z0-9] after AKIA; shorter runs hold no longer one
HEX = r"[0-9a-f]{16,}+"  # whole runs, so a shorter run never hides a longer one
VALUE_LENGTH = 12

#: Candidate strings of the entropy scan and the alphabet of their windows.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Character classes: name, pattern of the whole candidate, least entropy of a window in bits.
CLASSES = (("entropy_hex", r"^[0-9A-Fa-f]+$", 3.0), ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: Candidates that are never secrets: plain words and numbers between signs (a word has one case, or capitals that two small letters
#: follow), only digits and signs, UUIDs.  A window with a run of ten equal signs has under 3 bits, so runs need no rule.
ALLOWED = (r"^(?!.*(?:[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Z]{2}[a-z]|[a-z][A-Z](?![a-z]{2})))", r"^[0-9+/_=-]*$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")

_MARK = "\x01"


_FOUND = "array<struct<start:int,rank:int,kind:string,end:int>>"
_SPANS = "array<struct<start:int,end:int,match:string>>"
#: Pieces of a split text that are placed one after the other; such runs are placed by their lengths.
_RUN = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str) -> Column:
    """(start, end, match) of each leftmost non-overlapping match, in code points.

    Pieces between marks are matches and what lies between them in turn.  Runs of
    pieces are placed from 0 on, then moved by the length of the runs before.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, "\x02"), pattern, f"{_MARK}$0{_MARK}")
    none = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step(acc, piece):
        end = acc.at + F.length(piece)
        return F.struct(end.alias("at"), (~acc.hit).alias("hit"), F.when(acc.hit, F.concat(acc.out, F.array(F.struct(acc.at.alias("start"), end.alias("end"), piece.alias("match"))))).otherwise(acc.out).alias("out"))

    def placed(pieces):
        # _RUN is even, so every run begins between matches
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _RUN).cast("int")), lambda k: F.aggregate(F.slice(pieces, k * _RUN + 1, _RUN), start, step))
        moved = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
        shift = lambda acc, run: F.transform(run.out, lambda s: F.struct((s.start + acc.at).alias("start"), (s.end + acc.at).alias("end"), s.match.alias("match")))
        return F.flatten(F.aggregate(runs, moved, lambda acc, run: F.struct((acc.at + run.at).alias("at"), F.concat(acc.out, F.array(shift(acc, run))).alias("out")), lambda acc: acc.out))

    return F.when(text.rlike(pattern), _bound(F.split(marked, _MARK, -1), placed)).otherwise(none)


def hot_window(candidate: Column, least: float, window: int = WINDOW) -> Column:
    """(first, last): start of the first and end of the last window whose Shannon entropy reaches ``least`` bits; (0, 0) if none.

    One pass over the characters: the count of the one that leaves the window falls, that
    of the one that enters rises, and the sum of c log2 c is corrected for the two.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    w = lambda c: F.get(weight, c)
    code = lambda char: F.position(char, F.lit(ALPHABET)) - 1
    put = lambda counts, k, v: F.concat(F.slice(counts, 1, k), F.array(v), F.slice(counts, k + 2, len(ALPHABET)))
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def move(acc, char):
        full = acc["at"] >= window

        def left(k):
            """counts and sum without the character that leaves."""
            c = F.get(acc.counts, k)
            return F.struct(put(acc.counts, k, c - 1).alias("counts"), (acc["sum"] - w(c) + w(c - 1)).alias("sum"))

        def entered(old, k):
            c = F.get(old.counts, k)
            total = old["sum"] + w(c + 1) - w(c)
            hot = (acc["at"] >= window - 1) & (math.log2(window) - total / window >= least - 1e-9)
            fresh = hot & (acc["last"] == 0)
            return F.struct(
                F.concat(F.when(full, F.substring(acc.held, 2, window)).otherwise(acc.held), char).alias("held"), (acc["at"] + 1).alias("at"), put(old.counts, k, c + 1).alias("counts"), total.alias("sum"),
                F.when(fresh, acc["at"] - (window - 1)).otherwise(acc.first).alias("first"), F.when(hot, acc["at"] + 1).otherwise(acc["last"]).alias("last"),
            )

        before = F.when(full, _bound(code(F.substring(acc.held, 1, 1)), left)).otherwise(F.struct(acc.counts.alias("counts"), acc["sum"].alias("sum")))
        return _bound(F.struct(before.alias("old"), code(char).alias("k")), lambda x: entered(x.old, x.k))

    return F.aggregate(F.split(candidate, ""), start, move, lambda acc: F.struct(acc.first.alias("first"), acc["last"].alias("last")))


def _swept(spans: Column, end, take, kind: str) -> Column:
    """What ``take(at, span)`` gives for each span in order, concatenated; ``at`` is the largest ``end(span)`` of those before.

    Spans are taken in runs, whose first ``at`` comes from the ends of the runs before: no array grows by more than a run.
    """

    def step(acc, s):
        return F.struct(F.greatest(acc["at"], end(s)).alias("at"), F.concat(acc.out, take(acc["at"], s)).alias("out"))

    def swept(runs):
        tops = F.aggregate(runs, F.array(F.lit(0)), lambda tops, run: F.concat(tops, F.array(F.greatest(F.element_at(tops, -1), F.array_max(F.transform(run, end))))))
        return _bound(tops, lambda tops: F.flatten(F.transform(runs, lambda run, k: F.aggregate(run, F.struct(F.get(tops, k).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc.out))))

    count = F.ceil(F.size(spans) / _RUN).cast("int")
    return F.when(count > 0, _bound(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(spans, k * _RUN + 1, _RUN)), swept)).otherwise(F.array().cast(kind))


def _kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s.end.alias("end")))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan_secrets(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """``docs`` with ``name``: array of (start, rank, kind, end) by start, then kind; rank 0 to 2 are the base patterns.

    A null text counts as empty and has no secret; the whole of any text is read,
    in time that grows with its length, candidates of any length included.
    Each kind's matches are leftmost and do not overlap; kinds may.  An entropy
    span inside a base span is not repeated.  Rows, repeated ones included, and
    other columns stay as they are, but a column of that name is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(_FOUND)
    base_, runs_, more_ = free(docs, "_base", "_runs", "_more")
    assign = F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s.match, ASSIGN, 2)) >= VALUE_LENGTH)
    base = F.concat(_kind(assign, "assign", 0), _kind(found(text, ACCESS), "access", 1), _kind(found(text, HEX), "hex", 2))
    rows = docs.withColumn(base_, base).withColumn(runs_, found(text, CANDIDATE))
    rows = rows.withColumn(runs_, F.filter(runs_, lambda s: ~_any(s.match, ALLOWED)))
    more = none
    for rank, (kind, pattern, least) in enumerate(CLASSES, 3):
        others = [p for _, p, _ in CLASSES[: rank - 3]]
        mine = F.filter(runs_, lambda s: s.match.rlike(pattern) & ~_any(s.match, others))  # noqa: B023
        hot = F.transform(mine, lambda s: F.struct(s.start.alias("at"), hot_window(s.match, least).alias("w")))  # noqa: B023
        hot = F.filter(hot, lambda h: h.w["last"] > 0)
        more = F.concat(more, F.transform(hot, lambda h: F.struct((h.at + h.w.first).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (h.at + h.w["last"]).alias("end"))))  # noqa: B023
    rows = rows.withColumn(more_, F.when(F.size(runs_) > 0, more).otherwise(none))
    # base spans come first where starts are equal, so a span lies in one of them exactly if it ends by the largest end so far
    own = lambda at, s: F.filter(F.array(s), lambda x: (x["rank"] <= 2) | (x.end > at))
    swept = _swept(F.col(more_), lambda s: F.when(s["rank"] <= 2, s.end).otherwise(0), own, _FOUND)
    return rows.withColumn(more_, F.array_sort(F.concat(base_, more_))).withColumn(name, swept).drop(base_, runs_, more_)


def _any(value: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; long candidates are scanned like all others."""
    rows = scan_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s.rank <= 2)
    number = lambda k: F.size(F.filter("secrets", lambda s: s.rank == k)).cast("long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("secrets")).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with the spans, sorted by start, replaced, in time that grows with the text and the spans."""
    gap = lambda at, s: F.filter(F.array(F.struct(at.alias("start"), s.start.alias("end"))), lambda g: g.end >= g.start)

    def joined(chars):
        piece = lambda start, end: F.array_join(F.slice(chars, start + 1, end - start), "")
        gaps = _swept(spans, lambda s: s.end, gap, "array<struct<start:int,end:int>>")
        return F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(piece(g.start, g.end), F.lit(mask))), ""), piece(F.array_max(F.transform(spans, lambda s: s.end)), F.size(chars)))

    return _bound(F.split(text, ""), joined)


def mask_secrets(docs: DataFrame, mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """``docs`` with every span of a secret replaced; overlapping spans are one.  All columns stay, a null text stays null.

    ``length`` names a column that is to hold the code points of a text wherever the text changed.
    """
    (name,) = free(docs, "secrets")
    rows, changed = scan_secrets(docs, name), F.size(name) > 0
    rows = rows.withColumn("text", F.when(changed, _masked(F.col("text").cast("string"), F.col(name), mask)).otherwise(F.col("text")))
    if length is not None:
        rows = rows.withColumn(length, F.when(changed, F.length("text").cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return rows.select(*docs.columns)
