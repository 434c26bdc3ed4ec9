"""Quality rules: counts of words and repetitions, and perplexity bands under a Kneser-Ney model of each language.

The model has all word pairs of all texts.  Chunks of texts send the sorted numbers of their pairs,
with counts, to ranges of the spread numbers; a range adds them up, so that no word or pair, however
common, is more than a row of each chunk, and answers each chunk with what all texts have of the
pairs it sent.  Words are counted and answered likewise.  A chunk is then scored from its answers: no task
holds the model of a language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import drop, drop_since, keep, kept

LEAST_WORDS, WINDOW, REPEATED = 20, 8, 30
#: Pairs, and words, that ``language_models`` holds: each language has an equal share, and the count from which
#: on its pairs are held is the least for which they fit.  Some 30 bytes each in a worker.  ``quality_rules`` has no such bound.
ENTRIES = 1 << 20
#: Pairs a task collects before it sends them: those of a chunk.
BUFFER = 1 << 21
#: Bytes of a language's texts whose pairs a range holds in a round; rounds in which pairs are counted, so that only a share of them is on disk at a time.
RANGE, ROUNDS = 1 << 25, 2
#: Words scored at once.
SCORED = 1 << 17
#: Bands reach from this share of a language's median bits a word (texts that have thousands of copies stay above it, loops of a few
#: words do not) to so many times the distance of the upper quartile above it.
BELOW, ABOVE = 0.2, 9.0
#: Steps of a bit in which the medians are taken, and languages' texts that a band needs.
STEPS, LEAST_TEXTS = 256, 20
_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)
_GATHER = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The word before the first of a text.
BEGIN = _U(0)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Lower bounds of the classes of counts: single numbers, then 16 to an octave.
CLASSES = np.unique(np.concatenate((np.arange(1, 65), (64 * 2 ** (np.arange(1, 16 * 50) / 16)).astype(np.int64))))
_ROW = "lang string, kind string, part int, cut long, numbers array<bigint>, data binary"
_NAMES = ["lang", "kind", "part", "cut", "numbers", "data"]
_SENT = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("numbers", pa.list_(pa.int64())), ("data", pa.binary()), ("codes", pa.binary()), ("docs", pa.binary())])
_SENT_SQL = "lang string, kind string, part int, chunk long, numbers array<bigint>, data binary, codes binary, docs binary"
_DOC = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers as differences, and counts, byte plane by byte plane and compressed: a shuffle's own codec leaves planes of small numbers as they are."""
    steps = np.diff(keys, prepend=_U(0))
    planes = b"".join(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for x in (steps, counts))
    return len(keys).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    both = np.frombuffer(pa.decompress(data[8:], 16 * n, codec="zstd"), np.uint8).reshape(2, 8, n)
    steps, counts = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in both)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _merged(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*map(_unpacked, packs)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class _Block:
    """The words of some texts: their numbers in their language, the numbers of the words before them, their texts and languages."""

    buf: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    plain: np.ndarray
    ids: np.ndarray
    before: np.ndarray
    doc: np.ndarray
    lang: np.ndarray


def _blocks(column: pa.Array, langs: pa.Array):
    """(names of languages, first text, _Block) of the blocks of texts; a null language is ``und``."""
    kinds = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    names = kinds.dictionary.to_pylist()
    salt = W.mix(W.hashes_of([x or "" for x in names]) + _U(len("lang"))) if names else np.zeros(0, np.uint64)
    kind = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi, buf, offs in W.blocks(column):
        starts, ends, first = W.split(buf, offs)
        plain = W.hashes(buf, starts, ends, fold=False)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        ids = np.maximum(W.mix(plain ^ salt[kind[lo + doc]]) >> _U(32), _U(1))
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first[:-1][np.diff(first) > 0]] = BEGIN
        yield names, lo, _Block(buf, offs, starts, ends, first, plain, ids, before, doc, kind[lo:hi])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=_NAMES)


def _cut(keys: np.ndarray, counts: np.ndarray, parts: int, lang: str, kind: str) -> list[tuple]:
    """Rows of sorted numbers, one for each of ``parts`` ranges."""
    at = np.searchsorted(keys, np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64))
    return [(lang, kind, p, None, None, _packed(k, c)) for p, (k, c) in enumerate(zip(np.split(keys, at), np.split(counts, at))) if len(k)]


def _counts(parts: int):
    """(text, lang) to rows of pairs by range of their spread numbers, and of the words that are contexts."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        many = 0

        def out():
            for lang, keys in held.items():
                keys = np.concatenate(keys)
                before, often = np.unique(keys >> _U(32), return_counts=True)
                yield _rows(_cut(before << _U(32), often, _few(parts), lang, "contexts"))
                keys *= _SPREAD
                yield _rows(_cut(*np.unique(keys, return_counts=True), parts, lang, "pairs"))
            held.clear()

        for batch in batches:
            for names, _, b in _blocks(batch.column(0), batch.column(1)):
                pairs = (b.before << _U(32)) | b.ids
                spoken = b.lang[b.doc]
                for k in np.unique(spoken).tolist():
                    held.setdefault(names[k], []).append(pairs[spoken == k])
                many += len(pairs)
                if many >= BUFFER:
                    yield from out()
                    many = 0
        yield from out()

    return run


def _few(parts: int) -> int:
    """Ranges of words, of which there are far fewer than pairs."""
    return max(1, parts // 16)


def _commonest(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[int, np.ndarray, bytes]:
    """(least count held, numbers of entries by class of count, entries held): the least class of counts whose entries are ``most`` or fewer."""
    numbers = np.bincount(np.searchsorted(CLASSES, counts, side="right") - 1, minlength=len(CLASSES))
    cut = _least(numbers, most)
    return cut, numbers, _packed(keys[counts >= cut], counts[counts >= cut])


def _least(numbers: np.ndarray, most: int) -> int:
    above = np.cumsum(numbers[::-1])[::-1]
    fits = np.flatnonzero(above <= most)
    return int(CLASSES[fits[0]]) if len(fits) else int(CLASSES[-1]) + 1


def _added(parts: int, most: int):
    """For applyInArrow: what a range has counted.

    Pairs give the commonest ones, numbers of pairs by count and, for the words they
    end in, numbers of different pairs; contexts and continuations are added up.
    """

    def run(key, table):
        lang, kind, part = (k.as_py() for k in key)
        keys, counts = _merged(table.column("data").to_pylist())
        if kind == "pairs":
            cut, numbers, data = _commonest(keys, counts, 2 * most // parts + 64)
            ends, often = np.unique((keys * _GATHER) << _U(32), return_counts=True)
            rows = [(lang, "pairs", part, cut, numbers.tolist(), data), *_cut(ends, often, _few(parts), lang, "ends")]
        elif kind == "ends":
            cut, numbers, data = _commonest(keys, counts, 2 * most // _few(parts) + 64)
            rows = [(lang, "words", part, cut, numbers.tolist(), data)]
        else:
            rows = [(lang, kind, part, None, None, _packed(keys, counts))]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _held(cuts: dict[tuple[str, str], int], contexts: dict[str, np.ndarray] | None = None):
    """The entries that the models hold: counts from the language's cut on; of contexts those that are named."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, kind, part, _, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = _unpacked(data)
                ok = np.isin(keys, contexts[lang]) if contexts is not None else counts >= cuts[lang, kind]
                out.append((lang, kind, part, None, None, _packed(keys[ok], counts[ok])))
            yield _rows(out)

    return run


def discounts(numbers: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more from the numbers of entries that occur 1 to 4 times; 3/4 of each where those say nothing."""
    n1, n2, n3, n4 = (float(x) for x in numbers[:4])
    if not (n1 and n2 and n3):
        return np.array([0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.05, 0.05], [1, 2, 3])


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts


class Model:
    """Kneser-Ney estimates of a language from sorted arrays of numbers with their counts.

    A text is scored without itself: what it adds to the counts of pairs, contexts and
    continuations is taken off first, so that its rare pairs do not vouch for themselves.
    """

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], pair_numbers: np.ndarray, words: tuple[np.ndarray, np.ndarray], word_numbers: np.ndarray, contexts: tuple[np.ndarray, np.ndarray]):
        keys, counts = pairs
        order = np.argsort(keys)
        self.pairs, self.counts = keys[order], _narrow(counts[order])
        self.less, self.less_words = (np.concatenate(([0.0], discounts(n))) for n in (pair_numbers, word_numbers))
        self.contexts, self.total = contexts[0].astype(np.uint32), contexts[1].astype(np.float64)
        at = np.searchsorted(self.contexts, (self.pairs >> _U(32)).astype(np.uint32))
        # what backing off gets of a context's occurrences: the discounts of its held pairs, and all of the others
        self.mass = self.total - np.bincount(at, self.counts - self._less(self.counts), minlength=len(self.contexts))
        self.words, self.often = words[0].astype(np.uint32), _narrow(words[1])
        self.different = max(float(pair_numbers.sum()), 1.0)  # pairs
        self.rest = max(1.0 - float((self.often - self.less_words[np.minimum(self.often, 3)]).sum()) / self.different, 1e-9) / (float(word_numbers.sum()) + 1.0)

    @classmethod
    def answered(cls, pairs: tuple[np.ndarray, np.ndarray], pair_numbers: np.ndarray, words: tuple[np.ndarray, ...], word_numbers: np.ndarray) -> "Model":
        """What a chunk needs: its pairs with their counts and its words with (total, pairs of count 1, 2, more, different words before) in all texts.

        The numbers are those of entries that occur 1 to 4 times in the language, and of all.
        """
        self = cls.__new__(cls)
        self.pairs, self.counts = pairs[0], _narrow(pairs[1])
        self.less, self.less_words = (np.concatenate(([0.0], discounts(n))) for n in (pair_numbers, word_numbers))
        ids, total, one, two, more, often = words
        self.contexts = self.words = ids.astype(np.uint32)
        self.total = total.astype(np.float64)
        self.mass = self.less[1] * one + self.less[2] * two + self.less[3] * more
        self.often = _narrow(often)
        self.different = max(float(pair_numbers[4]), 1.0)
        left = self.less_words[1:] @ (word_numbers[0], word_numbers[1], word_numbers[4] - word_numbers[0] - word_numbers[1])
        self.rest = max(float(left) / self.different, 1e-9) / (float(word_numbers[4]) + 1.0)
        return self

    def _less(self, counts: np.ndarray) -> np.ndarray:
        return self.less[np.minimum(counts, 3)]

    @staticmethod
    def _value(among: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether there is one) of each number wanted."""
        if not len(among):
            return np.zeros(len(wanted), dtype=values.dtype), np.zeros(len(wanted), dtype=bool)
        wanted = wanted.astype(among.dtype)  # of one type: a search in mixed ones copies both
        at = np.minimum(np.searchsorted(among, wanted), len(among) - 1)
        hit = among[at] == wanted
        return np.where(hit, values[at], 0), hit

    def bits(self, doc: np.ndarray, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each word after the one before it, from all texts but its own, ``doc``."""
        pair = (before << _U(32)) | ids
        order = np.lexsort((pair, doc))
        d, p = doc[order], pair[order]
        fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])))
        first = np.flatnonzero(fresh)
        own = np.diff(np.append(first, len(p)))
        d, p = d[first], p[first]
        count, held = self._value(self.pairs, self.counts, p)
        left = np.maximum(count - own, 0)
        v, w = p >> _U(32), p & _U(0xFFFFFFFF)
        turn = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]))))
        among = np.cumsum(np.bincount(turn, minlength=len(v))) - 1
        total, known = self._value(self.contexts, self.total, v[turn])
        mass, _ = self._value(self.contexts, self.mass, v[turn])
        total = total - np.add.reduceat(own, turn)
        mass = mass - np.add.reduceat(np.where(held, self._less(count) - self._less(left), own), turn)
        usable = known & (total > 0)
        backoff = np.where(usable, np.maximum(mass, 1e-9) / np.maximum(total, 1), 1.0)[among]
        share = np.where(usable[among], (left - self._less(left)) / np.maximum(total, 1)[among], 0.0)
        often, _ = self._value(self.words, self.often, w)
        mine = (d.astype(np.uint64) << _U(32)) | w
        gone, many = np.unique(mine[held & (left == 0)], return_counts=True)
        often = np.maximum(often - self._value(gone, many, mine)[0], 0)
        single = (often - self.less_words[np.minimum(often, 3)]) / self.different + self.rest
        out = np.empty(len(pair))
        out[order] = -np.log2(share + backoff * single)[np.cumsum(fresh) - 1]
        return out


def language_models(docs: DataFrame, entries: int = ENTRIES) -> dict[str, Model]:
    """A model of each language of ``docs(text, lang)``, counted over all texts, small enough to look at: of its pairs and words the ``entries`` commonest.

    ``quality_rules`` does not use it: its texts get the counts of all their pairs.
    """
    spark, mark = docs.sparkSession, kept()
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs = rows.select(F.coalesce("lang", F.lit("und")).alias("lang")).distinct().count()
    parts, most = int(spark.conf.get("spark.sql.shuffle.partitions")), entries // max(langs, 1)
    added = lambda df: df.groupBy("lang", "kind", "part").applyInArrow(_added(parts, most), _ROW)
    counted = keep(added(rows.mapInArrow(W.tidy(_counts(parts)), _ROW)), "counts")
    words = keep(added(counted.where("kind = 'ends'")), "words", narrow=True)
    both = counted.where("kind = 'pairs'").unionAll(words)
    numbers: dict[tuple[str, str], np.ndarray] = {}
    some = F.filter(F.transform("numbers", lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda c: c.v > 0)
    for r in both.select("lang", "kind", F.explode(some).alias("c")).groupBy("lang", "kind", "c.k").agg(F.sum("c.v").alias("v")).toLocalIterator():
        numbers.setdefault((r.lang, r.kind), np.zeros(len(CLASSES), dtype=np.int64))[r.k] = r.v
    cuts = {(r.lang, r.kind): max(r.cut, _least(numbers.get((r.lang, r.kind), np.zeros(len(CLASSES))), most)) for r in both.groupBy("lang", "kind").agg(F.max("cut").alias("cut")).collect()}
    found = _collected(both.mapInArrow(W.tidy(_held(cuts)), _ROW))
    pairs = {lang: (keys * _GATHER, counts) for (lang, kind), (keys, counts) in found.items() if kind == "pairs"}
    named = {lang: np.unique(keys >> _U(32)) << _U(32) for lang, (keys, _) in pairs.items()}
    contexts = _collected(counted.where("kind = 'contexts'").mapInArrow(W.tidy(_held({}, named)), _ROW))
    drop_since(spark, mark)
    out = {}
    for lang in named:
        ids, total = contexts[lang, "contexts"]
        ends, often = found[lang, "words"]
        out[lang] = Model(pairs[lang], numbers[lang, "pairs"], (ends >> _U(32), often), numbers[lang, "words"], (ids >> _U(32), total))
    return out


def _collected(rows: DataFrame) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    held: dict[tuple[str, str], list[bytes]] = {}
    for r in rows.select("lang", "kind", "data").toLocalIterator():
        held.setdefault((r.lang, r.kind), []).append(bytes(r.data))
    return {k: _merged(v) for k, v in held.items()}


def _repeated(plain: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Of each text: its words that lie in runs of WINDOW words found twice or more in it."""
    g = W.grams(plain, WINDOW)
    at = np.flatnonzero(doc[: len(g)] == doc[WINDOW - 1 :]) if len(g) else np.zeros(0, np.int64)
    key = W.mix(g[at] + doc[at].astype(np.uint64) * _SPREAD)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order] = np.append(same, False) | np.append(False, same) if len(at) else False
    edge = np.zeros(len(plain) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return np.bincount(doc, np.cumsum(edge)[:-1] > 0, minlength=texts).astype(np.int64)


def _said_again(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _planes(*columns: np.ndarray) -> bytes:
    """Whole numbers of some columns of one length, byte plane by byte plane and compressed."""
    planes = b"".join(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for x in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _columns(data: bytes, many: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    both = np.frombuffer(pa.decompress(data[8:], 8 * many * n, codec="zstd"), np.uint8).reshape(many, 8, n)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in both]


def _said(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SENT)


def _check(keys: np.ndarray) -> int:
    """A number that tells two lists of keys apart."""
    return int(np.bitwise_xor.reduce(W.mix(keys)).view(np.int64)) if len(keys) else 0


def _shared(keys: np.ndarray, columns: list[np.ndarray], parts: int, turn: int, rounds: int, **row) -> list[dict]:
    """Rows of sorted keys and their columns, one for each range that has some; the keys are those of round ``turn``."""
    bounds = [(p << 64) // (parts * rounds) for p in range(turn * parts + 1, (turn + 1) * parts)]
    at = np.searchsorted(keys, np.array(bounds, dtype=np.uint64)).tolist()
    return [
        row | {"part": turn * parts + p, "numbers": [_check(keys[i:j])], "data": _planes(np.diff(keys[i:j], prepend=_U(0)), *(c[i:j] for c in columns))}
        for p, (i, j) in enumerate(zip([0, *at], [*at, len(keys)])) if j > i
    ]


def _held_chunks(batches, most: int, docs=None):
    """(chunk, {language: (sizes of its texts, numbers of their words, what ``docs`` makes of them)}) of whole texts, in the order they come; some ``most`` words a chunk."""
    base, turn, held, many = TaskContext.get().partitionId() << 32, 0, {}, 0
    end = lambda: {lang: (np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v]), [x[2] for x in v]) for lang, v in held.items()}
    for batch in batches:
        for names, lo, b in _blocks(batch.column(1), batch.column(2)):
            spoken, sizes = b.lang[b.doc], np.diff(b.first)
            table = docs(batch.column(0).slice(lo, len(sizes)), b) if docs else None
            for k in np.unique(b.lang).tolist():
                own = b.lang == k
                held.setdefault(names[k], []).append((sizes[own], b.ids[spoken == k], table.filter(pa.array(own)) if docs else None))
            many += len(b.ids)
            if many >= most:
                yield base + turn, end()
                held, many, turn = {}, 0, turn + 1
    if held:
        yield base + turn, end()


def _before(sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The words before those of texts."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = BEGIN
    return out


def _words_of(before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different words of a chunk, the mark before its texts included, and how often they stand before another."""
    contexts, often = np.unique(before, return_counts=True)
    words = np.union1d(contexts, ids)
    total = np.zeros(len(words), dtype=np.int64)
    total[np.searchsorted(words, contexts)] = often
    return words, total


def _pairs_sent(parts: dict[str, int], turn: int):
    """(doc_id, text, lang) to the different pairs of each chunk whose spread numbers lie in share ``turn`` of ROUNDS."""
    rounds, most = ROUNDS, BUFFER
    lo, hi = _U((turn << 64) // rounds), _U(((turn + 1 << 64) - 1) // rounds)

    def run(batches):
        for chunk, held in _held_chunks(batches, most):
            rows = []
            for lang, (sizes, ids, _) in held.items():
                keys = ((_before(sizes, ids) << _U(32)) | ids) * _SPREAD
                keys, often = np.unique(keys[(keys >= lo) & (keys <= hi)], return_counts=True)
                rows += _shared(keys, [often], parts.get(lang, 1), turn, rounds, lang=lang, kind="pairs", chunk=chunk)
            yield _said(rows)

    return run


def _words_sent(parts: dict[str, int]):
    """(doc_id, text, lang) to the different words of each chunk, with their occurrences before others."""

    most = BUFFER

    def run(batches):
        for chunk, held in _held_chunks(batches, most):
            rows = []
            for lang, (sizes, ids, _) in held.items():
                words, total = _words_of(_before(sizes, ids), ids)
                rows += _shared(words << _U(32), [total], parts.get(lang, 1), 0, 1, lang=lang, kind="asked", chunk=chunk)
            yield _said(rows)

    return run


def _met(packs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(different keys, for each key sent its place among them, where each pack begins and ends)."""
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in packs]
    different, at = np.unique(np.concatenate(keys), return_inverse=True)
    return different, at, np.cumsum([0, *map(len, keys)]).tolist()


def _first_numbers(counts: np.ndarray) -> list[int]:
    """Entries that occur 1 to 4 times, and all."""
    return [*np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist(), len(counts)]


def _pairs_counted(words_in: dict[str, int]):
    """For applyInArrow: a range's pairs are added up; each chunk gets their counts in all texts, ranges of words what they say of words."""

    def run(key, table):
        lang = key[0].as_py()
        packs = [_columns(x, 2) for x in table.column("data").to_pylist()]
        keys, at, cut = _met(packs)
        counts = np.bincount(at, np.concatenate([x[1] for x in packs])).astype(np.int64)
        rows = [
            {"lang": lang, "kind": "counts", "part": key[1].as_py(), "chunk": chunk, "numbers": check, "data": _planes(counts[at[i:j]])}
            for chunk, check, i, j in zip(table.column("chunk").to_pylist(), table.column("numbers").to_pylist(), cut, cut[1:])
        ]
        pair = keys * _GATHER
        before, v = np.unique(pair >> _U(32), return_inverse=True)
        ends, often = np.unique(pair & _U(0xFFFFFFFF), return_counts=True)
        words = np.union1d(before, ends)
        columns = np.zeros((4, len(words)), dtype=np.int64)
        columns[0, np.searchsorted(words, ends)] = often
        for k in (1, 2, 3):
            columns[k, np.searchsorted(words, before)] = np.bincount(v[np.minimum(counts, 3) == k], minlength=len(before))
        rows += _shared(words << _U(32), list(columns), words_in.get(lang, 1), 0, 1, lang=lang, kind="words")
        rows.append({"lang": lang, "kind": "numbers", "numbers": _first_numbers(counts)})
        return pa.Table.from_batches([_said(rows)])

    return run


def _words_counted(key, table):
    """For applyInArrow: a range's words are added up; each chunk gets what all texts have of its words."""
    lang, kinds = key[0].as_py(), np.array(table.column("kind").to_pylist())
    packs = [_columns(x, 2 if k == "asked" else 5) for k, x in zip(kinds, table.column("data").to_pylist())]
    keys, at, cut = _met(packs)
    columns = np.zeros((5, len(keys)), dtype=np.int64)  # total, pairs of count 1, 2, more, different words before
    for kind, x, i, j in zip(kinds, packs, cut, cut[1:]):  # keys of a pack differ
        if kind == "asked":
            columns[0, at[i:j]] += x[1].astype(np.int64)
        else:
            for k, c in zip((4, 1, 2, 3), x[1:]):
                columns[k, at[i:j]] += c.astype(np.int64)
    rows = [
        {"lang": lang, "kind": "told", "part": key[1].as_py(), "chunk": chunk, "numbers": check, "data": _planes(*(c[at[i:j]] for c in columns))}
        for kind, chunk, check, i, j in zip(kinds, table.column("chunk").to_pylist(), table.column("numbers").to_pylist(), cut, cut[1:]) if kind == "asked"
    ]
    rows.append({"lang": lang, "kind": "numbers", "numbers": _first_numbers(columns[4][columns[4] > 0])})
    return pa.Table.from_batches([_said(rows)])


def _base(ids: pa.Array, b: _Block) -> pa.RecordBatch:
    """The counts of each text of a block that need no other text."""
    many = len(b.offs) - 1
    chars = np.concatenate(([0], np.cumsum((b.buf & 0xC0) != 0x80, dtype=np.int64)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[b.buf], dtype=np.int64)))
    whole = b.buf.tobytes()
    lines = [_said_again(whole[x:y]) for x, y in zip(b.offs[:-1].tolist(), b.offs[1:].tolist())]
    columns = [np.diff(b.first), np.bincount(b.doc, chars[b.ends] - chars[b.starts], minlength=many), np.diff(symbols[b.offs]), np.array(lines), _repeated(b.plain, b.doc, many)]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in columns)], names=_DOC)


def _texts_sent():
    """(doc_id, text, lang) to the texts of each chunk: their counts, and their words as numbers in the order of how common they are in it."""
    most = BUFFER

    def run(batches):
        for chunk, held in _held_chunks(batches, most, _base):
            rows = []
            for lang, (_, ids, docs) in held.items():
                words, at, often = np.unique(ids, return_inverse=True, return_counts=True)
                rank = np.empty(len(words), dtype=np.int64)
                rank[np.argsort(-often, kind="stable")] = np.arange(len(words))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(pa.Table.from_batches(docs).combine_chunks())
                rows.append({"lang": lang, "kind": "texts", "chunk": chunk, "data": _packed(words, often), "codes": _planes(rank[at]), "docs": sink.getvalue().to_pybytes()})
            yield _said(rows)

    return run


def _answers(rows: list[dict], many: int, keys: np.ndarray) -> list[np.ndarray] | None:
    """The columns that ranges tell of a chunk's sorted keys; None if they were told of others."""
    rows = sorted(rows, key=lambda r: r["part"])
    check = 0
    for r in rows:
        check ^= r["numbers"][0]
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*(_columns(r["data"], many) for r in rows))] or [np.zeros(0, np.int64)] * many
    return columns if len(columns[0]) == len(keys) and check == _check(keys) else None


def _scores(numbers):
    """For applyInArrow: a chunk's texts and what it was told of its pairs and words to the counts of each text and its bits a word.

    ``numbers`` is a broadcast dict of the numbers of each language.  A text does not fit if the answers are those of other texts.
    """

    def run(key, table):
        out, by = [], {}
        for r in table.to_pylist():
            by.setdefault(r["lang"], {}).setdefault(r["kind"], []).append(r)
        for lang, kinds in by.items():
            for text in kinds.get("texts", []):  # one, unless the rows of a task came in another order
                docs = pa.ipc.open_stream(text["docs"]).read_all()
                sizes = docs.column("n_words").to_numpy()
                words, often = _unpacked(text["data"])
                ids = words[np.argsort(-often, kind="stable")][_columns(text["codes"], 1)[0].astype(np.int64)] if len(words) else words
                before = _before(sizes, ids)
                pairs, known = np.unique(((before << _U(32)) | ids) * _SPREAD), _words_of(before, ids)[0]
                counts, told = _answers(kinds.get("counts", []), 1, pairs), _answers(kinds.get("told", []), 5, known << _U(32))
                fits = counts is not None and told is not None
                mean = np.zeros(len(sizes))
                if fits and len(ids):
                    pairs = pairs * _GATHER
                    order = np.argsort(pairs)
                    model = Model.answered((pairs[order], counts[0][order]), numbers.value[lang, "pairs"], (known, *told), numbers.value[lang, "words"])
                    mean = _means(model, sizes, before, ids)
                more = [pa.array([lang] * len(sizes), pa.string()), pa.array(mean, mask=sizes == 0), pa.array([fits] * len(sizes), pa.bool_())]
                out.append(pa.Table.from_arrays([*docs.columns, *more], names=[*_DOC, "lang", "bits", "fits"]))
        if not out:
            return pa.table({c: pa.array([], t) for c, t in [*((c, pa.int64()) for c in _DOC), ("lang", pa.string()), ("bits", pa.float64()), ("fits", pa.bool_())]})
        return pa.concat_tables(out)

    return run


def _means(model: Model, sizes: np.ndarray, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bits a word of each text, some SCORED words or one text at a time."""
    upto, out, a = np.cumsum(sizes), np.zeros(len(sizes)), 0
    while a < len(sizes):
        done = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + SCORED, side="right")))
        doc, own = np.repeat(np.arange(b - a), sizes[a:b]), slice(done, int(upto[b - 1]))
        if len(doc):
            # summed one after another, so that a text's sum does not depend on its neighbours
            out[a:b] = np.bincount(doc, model.bits(doc, before[own], ids[own]), minlength=b - a) / np.maximum(sizes[a:b], 1)
        a = b
    return out


def scored_texts(rows: DataFrame) -> DataFrame:
    """The counts of every row of ``rows(doc_id, text, lang)``, its bits a word under the counts of all other texts, and ``fits``.

    Texts are read once for each kind of question; ``fits`` is false where a chunk had other texts when its pairs were counted.
    """
    spark, mark = rows.sparkSession, kept()
    size = rows.groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.sum(F.octet_length("text")).alias("b"))
    ranges = {r.lang: max(1, -(-(r.b or 0) // RANGE)) for r in size.toLocalIterator()}
    counted = [keep(rows.mapInArrow(W.tidy(_pairs_sent(ranges, t)), _SENT_SQL).groupBy("lang", "part").applyInArrow(_pairs_counted(ranges), _SENT_SQL), "counts") for t in range(ROUNDS)]
    pairs = counted[0]
    for more in counted[1:]:
        pairs = pairs.unionAll(more)
    asked = rows.mapInArrow(W.tidy(_words_sent(ranges)), _SENT_SQL).unionAll(pairs.where("kind = 'words'"))
    words = keep(asked.groupBy("lang", "part").applyInArrow(_words_counted, _SENT_SQL), "words")
    numbers = {}
    for kind, table in (("pairs", pairs), ("words", words)):
        sums = [F.sum(F.col("numbers")[k]).alias(f"n{k}") for k in range(5)]
        for r in table.where("kind = 'numbers'").groupBy("lang").agg(*sums).toLocalIterator():
            numbers[r.lang, kind] = np.array([r[f"n{k}"] for k in range(5)], dtype=np.int64)
    told = spark.sparkContext.broadcast(numbers)
    texts = rows.mapInArrow(W.tidy(_texts_sent()), _SENT_SQL)
    every = texts.unionAll(pairs.where("kind = 'counts'")).unionAll(words.where("kind = 'told'"))
    kind = ", ".join([*(f"{c} long" for c in _DOC), "lang string, bits double, fits boolean"])
    scored = keep(every.groupBy("chunk").applyInArrow(_scores(told), kind), "scored")
    drop_since(spark, mark, scored)
    return scored


def bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(lang, lower, upper): bits a word between which a language's texts are kept, from all ``scored(lang, bits)``.

    Median and upper quartile come from counts of the texts by steps of 1/256 bit.  A language of fewer than 20 texts has no band.
    """
    counted = scored.groupBy("lang", F.floor(F.col("bits") * STEPS).alias("k")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("lang").orderBy("k")
    counted = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(Window.partitionBy("lang")))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("k")))
    of = counted.groupBy("lang").agg(at(0.5).alias("mid"), at(0.75).alias("high"), F.max("all").alias("all")).where(F.col("all") >= LEAST_TEXTS)
    mid, high = (F.col(c) / STEPS for c in ("mid", "high"))
    least = F.lit(0.1)  # so that many equal texts do not make a band without width
    return of.select("lang", (mid * below).alias("lower"), (mid + above * F.greatest(high - mid, least)).alias("upper"))


def quality_rules(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, lower, upper of every row of ``docs(doc_id, text, lang)``.

    Words are runs without ASCII white space, word_chars their code points, n_symbols
    the characters ``#*$%&|<>`` of the text, n_dup_lines its lines with a word that equal
    an earlier one, n_repeat_words its words in runs of 8 words found twice or more.
    base_failed: fewer than 20 words, or over 30 % of them in such runs.  Other texts are
    kept if their perplexity (geometric mean of 1 / p over words, under the model of all
    pairs of their language that all other texts are counted for) lies within their language's
    band; in a language of fewer than 20 such texts all are.

    A null text is empty; an empty one, or one of white space only, has zeros, fails and has no perplexity.
    A null lang is ``und``.  Repeated rows, ids and null ids are rows like others.
    Words are told apart by 32 bits within a language, windows by 64.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = scored_texts(rows)
    if scored.where("NOT fits").limit(1).count():  # the rows came otherwise each time; written out, they come in one order
        drop(scored)
        rows = keep(rows, "rows")
        scored = scored_texts(rows)
        drop(rows)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    limits = bands(scored.where("NOT base_failed"), below, above)
    limits = keep(limits, "bands", narrow=True)
    if limits.count() <= 10_000:  # a name and two numbers each
        limits = F.broadcast(limits)
    inside = F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(True))
    out = scored.join(limits, "lang", "left")
    power = lambda c: F.pow(F.lit(2.0), F.col(c))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), power("bits").alias("perplexity"), power("lower").alias("lower"), power("upper").alias("upper"))
