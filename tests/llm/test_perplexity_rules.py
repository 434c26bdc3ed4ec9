import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kumiki.llm import perplexity_rules as P

WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    r = random.Random(2)
    lists = {"en": ["the", "of", "cat", "Dog", "sat", "on", "mat", "é", "x1"], "de": ["der", "die", "Hund", "the", "ß"]}
    rows = []
    for k in range(150):
        lang = r.choice(["en", "en", "de"])
        w = [r.choice(lists[lang]) + r.choice(["", "", "", str(r.randrange(50))]) for _ in range(r.randrange(60))]
        rows.append((k, "".join(x + r.choice([" ", " ", "\n", "\t"]) for x in w), lang))
    line = "the very same line of nine words comes again"
    rows += [(200, None, "en"), (201, "", None), (202, " \n\t", "en"), (203, "one", None), (204, "\n".join([line] * 9) + "\n\n \n", "en"), (205, "a b " * 400, "en"), (206, rows[3][1], "en"), (206, rows[3][1], "en"), (None, "the cat # * $ % & | < > sat", "en")]
    rows += [(207, " ".join(f"w{k % 31}" for k in range(31)) + " end " + " ".join(f"w{k}" for k in range(11)), "en"), (208, "z" * 30_000, "xx")]
    return rows


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = collections.Counter(windows)
    covered = {i + j for i, g in enumerate(windows) if many[g] > 1 for j in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def kneser_ney(rows):
    """Perplexity of each row under the unpruned pair model of its language, its own counts taken off, by dictionaries."""
    pairs, out = collections.defaultdict(collections.Counter), []
    split = lambda t: re.findall(WORD, t or "")
    for _, t, lang in rows:
        w = split(t)
        pairs[lang or "und"].update(zip([None, *w], w))

    def less(numbers):
        n = [sum(1 for c in numbers if c == k) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1] and n[2]):
            return lambda c: 0.75 if c else 0.0
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    found = {}
    for lang, count in pairs.items():
        ends, after = collections.Counter(w for _, w in count), collections.defaultdict(list)
        for v, w in count:
            after[v].append(w)
        d2, d1 = less(count.values()), less(ends.values())
        rest = max(1 - sum(c - d1(c) for c in ends.values()) / len(count), 1e-9) / (len(ends) + 1)
        found[lang] = count, ends, after, d2, d1, rest
    for _, t, lang in rows:
        w = split(t)
        if not w:
            out.append(None)
            continue
        count, ends, after, d2, d1, rest = found[lang or "und"]
        own = collections.Counter(zip([None, *w], w))
        gone = collections.Counter(x for (v, x), c in own.items() if count[v, x] == c)
        logs = 0.0
        for v, x in zip([None, *w], w):
            left = {y: count[v, y] - own[v, y] for y in after[v]}
            total = sum(left.values())
            a = ends[x] - gone[x]
            single = (a - d1(a)) / len(count) + rest
            logs += math.log(((left[x] - d2(left[x])) + sum(map(d2, left.values())) * single) / total if total else single)
        out.append(math.exp(-logs / len(w)))
    return out


@pytest.mark.parametrize("buffer", [1 << 20, 100])
def test_rules_and_perplexity_by_brute_force(spark, monkeypatch, buffer):
    monkeypatch.setattr(P, "BUFFER", buffer)
    rows = corpus()
    d = spark.createDataFrame([(*r, None, 7) for r in rows], "doc_id long, text string, lang string, kept boolean, bits int").repartition(4)
    got = P.quality_rules(d).collect()
    want = [(i, *base(t), None if q is None else round(q, 3)) for (i, t, _), q in zip(rows, kneser_ney(rows))]
    have = [(*[x[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], None if x.perplexity is None else round(x.perplexity, 3)) for x in got]
    close = lambda a, b: a[:7] == b[:7] and (a[7] == b[7] or abs(a[7] - b[7]) < 2e-3 * a[7])
    assert len(have) == len(want) and all(close(a, b) for a, b in zip(sorted(have, key=str), sorted(want, key=str)))
    assert all(x.kept == (not x.base_failed and (x.lower is None or x.lower <= x.perplexity <= x.upper)) for x in got)


def test_bands_reject_both_sides(spark):
    r = random.Random(8)
    usual = ["the", "of", "and", *[f"word{k}" for k in range(200)]]
    rows = [(k, " ".join(r.choice(usual) for _ in range(80)), "en") for k in range(300)]
    rows += [(900, " ".join("".join(r.choice("bcdfgh") for _ in range(9)) for _ in range(80)), "en")]
    rows += [(901, " ".join(["the of"] * 3 + [x for k in range(40) for x in ("and", r.choice(["the", "of"]))]), "en"), (902, "only text of its tongue " * 2 + " ".join(f"u{k}" for k in range(30)), "xx")]
    got = {x.doc_id: x for x in P.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), below=0.6, above=6).collect()}
    assert all(got[k].kept for k in range(300)) and not got[900].kept and got[900].perplexity > got[900].upper and got[902].kept and got[902].lower is None
    assert got[901].perplexity < got[901].lower or got[901].base_failed


def test_held_entries_are_bounded_and_probabilities_sum_to_one(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, small = P.language_models(d), P.language_models(d, entries=80)
    assert sum(len(m.pairs) for m in small.values()) <= 80 < sum(len(m.pairs) for m in whole.values()) and sum(len(m.words) for m in small.values()) <= 80
    for models in (whole, small):
        m = models["en"]
        single = (m.often - m.less_words[np.minimum(m.often, 3)]) / m.different + m.rest
        words = len(whole["en"].words) + 1  # one that no text has
        assert abs(single.sum() + m.rest * (words - len(m.words)) - 1) < 1e-6
        for v, total, mass in zip(m.contexts, m.total, m.mass):
            c = m.counts[m.pairs >> np.uint64(32) == v]
            assert abs(((c - m.less[np.minimum(c, 3)]).sum() + mass) / total - 1) < 1e-6 and 0 < mass <= total


def test_numbers_survive_packing():
    keys = np.array([0, 5, 1 << 40, (1 << 64) - 1], dtype=np.uint64)
    k, c = P._unpacked(P._packed(keys, np.array([1, 2, 1 << 40, 3])))
    assert (k == keys).all() and c.tolist() == [1, 2, 1 << 40, 3] and len(P._unpacked(P._packed(keys[:0], keys[:0]))[0]) == 0


def test_no_rows(spark):
    assert P.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def same_perplexity(got, rows):
    want = sorted(((str(i), n) for (i, _, _), n in zip(rows, kneser_ney(rows))), key=str)
    have = sorted(((str(x.doc_id), x.perplexity) for x in got), key=str)
    return len(have) == len(want) and all(a[0] == b[0] and (a[1] is b[1] is None or abs(a[1] - b[1]) < 2e-3 * a[1]) for a, b in zip(have, want))


def test_more_pairs_than_models_used_to_hold(spark):
    r = random.Random(5)
    rows = [(k, " ".join(f"w{int(400_000 * r.random())}" for _ in range(9000)), "en") for k in range(130)]
    assert len({p for _, t, _ in rows for p in zip(t.split(), t.split()[1:])}) > P.ENTRIES
    got = P.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert same_perplexity(got, rows)


def test_many_chunks_and_ranges_and_rows_that_come_in_other_orders(spark, monkeypatch):
    for name, value in (("BUFFER", 200), ("RANGE", 700), ("ROUNDS", 3)):
        monkeypatch.setattr(P, name, value)
    rows = [x for x in corpus() if x[0] not in (206, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def anyhow(batches):
        table = pa.Table.from_batches(batches)
        yield from table.take(np.random.default_rng().permutation(table.num_rows)).to_batches()

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert same_perplexity(P.quality_rules(d).collect(), rows)
        loose = d.mapInArrow(anyhow, d.schema)
        assert not P.scored_texts(loose.select("doc_id", "text", "lang")).agg({"fits": "min"}).first()[0]
        assert same_perplexity(P.quality_rules(loose).collect(), rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
