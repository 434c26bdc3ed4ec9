import collections
import random
import re

import pytest

from kumiki.llm import collocations


def brute(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in often.items() if other == lang):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right, n[lang]))
    return {(lang, i, p.decode(), -a, left, right, many, -s) for lang, rows in out.items() for i, (s, a, p, left, right, many) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize("bits, buffer, top", [(1 << 16, 1 << 20, 2000), (64, 40, 7)])
def test_phrases_against_brute_force(spark, monkeypatch, bits, buffer, top):
    monkeypatch.setattr(collocations, "BUFFER", buffer)
    r = random.Random(9)
    parts = ["New York", "new york City", "der  die", "é x", "a a a a", "B-2", "in the end", "in the", "end", "of", "ſ", "K", "k"]
    text = lambda: "".join(r.choice(parts) + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(r.randrange(30)))
    rows = [(text(), r.choice(["en", "en", "de", None, "und"])) for _ in range(120)] + [(None, "en"), ("", None), ("   .. \n", "xx"), ("a b c d e f " * 4000, "long"), ("one two", "en"), ("one two", "en")]
    d = spark.createDataFrame([(t, lang, k, "x", None) for k, (t, lang) in enumerate(rows)], "text string, lang string, id long, phrase string, cnt int").repartition(5)
    got = [tuple(x) for x in collocations.collocations(d, least=5, top=top, bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 5, top)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).count() == 0


def test_scores_pass_64_bits(spark):
    t = " ".join(["x y"] * 100_000)
    got = collocations.collocations(spark.createDataFrame([(t, "l")], "text string, lang string"), longest=2).collect()
    assert {(x.phrase, x.a, x.score) for x in got} == {("x y", 100_000, 1000 * 100_000 * 200_000 // 100_000**2), ("y x", 99_999, 1000 * 99_999 * 200_000 // 100_000**2)}
