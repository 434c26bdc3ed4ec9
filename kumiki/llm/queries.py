"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import collocations, decontaminate, jaccard_join, lm_score, page_text, perplexity_rules, quality, secret_scan, source_mix, spotsigs, suffix_dedup, toxicity, whitening
from .tables import read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(ship(spark), sf_dir, "documents")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(_docs(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_docs(spark, sf_dir), read(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_docs(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.spot_fingerprints(_docs(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_docs(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_docs(spark, sf_dir), read(spark, sf_dir, "labels"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(read(ship(spark), sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(c, 9).alias(c)
    return decontaminate.leaks(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", share("question_overlap"), share("answer_overlap"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(ship(spark), sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules.quality_rules(_docs(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_score, op2_quality, op3_secrets, op4_jaccard_join, op5_spotsigs, op6_source_mix, op7_suffix_dedup, op8_toxicity, op9_page_text, op10_decontaminate, op11_whitening, op12_quality_rules, op13_collocations, pipeline)
    return {f.__name__: f for f in own}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))))"

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, {_SHINGLES} AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
edge AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.root AS component_id, coalesce(l.c, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, count(*) AS c FROM both_ways GROUP BY a) l ON l.a = d.doc_id
JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('17:' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
        / (CASE WHEN chars >= 3 * size AND chars <= 12 * size THEN 1.0 ELSE 0.5 END)::DOUBLE AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS stop, (source_size * 2.0::DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level,
        row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM r),
t AS (SELECT source, source_size, CASE WHEN ratio > level THEN (SELECT arg_min(level, place) FROM l WHERE ratio > level) * w ELSE stop END AS target FROM l),
p AS (SELECT k.*, t.source_size, t.target, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
f AS (SELECT *, target - epochs * source_size AS rest FROM e)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN size > 0 AND upto - size < rest AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM f
"""

OP10_SQL = rf"""
WITH t AS (SELECT item_id, regexp_replace({_FOLD}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM benchmark),
p AS (SELECT item_id, 'question' AS part, CASE WHEN contains(t, chr(10)) THEN regexp_replace(t, '\n[^\n]*$', '') ELSE t END AS t FROM t
  UNION ALL SELECT item_id, 'answer', CASE WHEN contains(t, chr(10)) THEN regexp_extract(t, '\n([^\n]*)$', 1) ELSE '' END FROM t),
w AS (SELECT item_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM p),
k AS (SELECT item_id, part, ws, least(len(ws), 5) AS k FROM w WHERE len(ws) > 0),
b AS (SELECT DISTINCT item_id, part, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS g FROM k),
n AS (SELECT item_id, part, k, count(*) AS n FROM b GROUP BY ALL),
x AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS g FROM x, (SELECT DISTINCT k FROM k) WHERE len(ws) >= k),
o AS (SELECT d.doc_id, b.item_id, b.part, count(*)::DOUBLE / any_value(n.n) AS share FROM d JOIN b ON d.k = b.k AND d.g = b.g JOIN n ON n.item_id = b.item_id AND n.part = b.part GROUP BY d.doc_id, b.item_id, b.part)
SELECT q.doc_id, q.item_id, round(q.share, 9) AS question_overlap, round(CASE WHEN n.n IS NULL THEN 1.0 ELSE coalesce(a.share, 0.0) END, 9) AS answer_overlap
FROM o q LEFT JOIN n ON n.item_id = q.item_id AND n.part = 'answer' LEFT JOIN o a ON a.doc_id = q.doc_id AND a.item_id = q.item_id AND a.part = 'answer'
WHERE q.part = 'question' AND q.share >= 0.75 AND (n.n IS NULL OR a.share >= 0.75)
"""


OP13_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex({_FOLD}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS p FROM t)),
s AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
x AS (SELECT c.lang, c.k, c.phrase, c.a, j, array_to_string(c.ws[1:j], ' ') AS head, array_to_string(c.ws[j + 1:], ' ') AS rest
      FROM c, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < c.k),
y AS (SELECT x.lang, x.phrase, x.a, x.j, h.a AS l, r.a AS r, s.n, ((1000::HUGEINT * x.a * s.n) // (h.a::HUGEINT * r.a)) AS score
      FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.rest JOIN s ON s.lang = x.lang),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM y),
inside AS (SELECT DISTINCT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase, c.a
      FROM c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS m) WHERE m < c.k AND i + m - 1 <= c.k),
o AS (SELECT z.lang, z.phrase, z.a, z.l, z.r, z.n, z.score::BIGINT AS score FROM z ANTI JOIN inside i ON i.lang = z.lang AND i.phrase = z.phrase AND i.a = z.a WHERE cut = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op6_source_mix": OP6_SQL, "op10_decontaminate": OP10_SQL, "op13_collocations": OP13_SQL}
