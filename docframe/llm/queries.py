"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._runtime import documents
from .decontaminate import decontaminate
from .fingerprint import fingerprints
from .jaccard_join import jaccard_classes
from .language_id import language_id
from .sentencepiece_codec import sentencepiece_encode
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_output import token_output
from .toxicity import toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), PIECES)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), WORD_BPE)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(documents(spark, sf_dir), PIECES, keep_ids=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "worst_sentence")


_ALL = (
    op1_token_counts, op2_fingerprint, op3_suffix_dedup, op4_token_output, op5_jaccard_join,
    op6_substring_dedup, op7_sentencepiece, op8_decontaminate, op9_language_id, op10_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, length(x) // 2 AS n, x,
             list_transform(range(length(x) // 2 - 199), lambda i: md5(substr(x, 2 * i + 1, 400))) AS hs FROM d),
u AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS i FROM k),
r AS (SELECT h FROM u GROUP BY h HAVING count(*) > 1),
f AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM u JOIN r USING (h)),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM s),
t AS (SELECT doc_id, sum(z - a)::BIGINT AS gone, count(*) AS spans, max(z) AS last FROM s GROUP BY doc_id),
p AS (SELECT e.doc_id, string_agg(substr(d.x, (2 * b + 1)::BIGINT, (2 * (a - b))::BIGINT), '' ORDER BY a) AS head
      FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT k.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(p.head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM k LEFT JOIN t ON t.doc_id = k.doc_id LEFT JOIN p ON p.doc_id = k.doc_id
"""

_OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS c
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * c.c >= 80 * (c.n - c.c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
FROM s LEFT JOIN m ON m.x = s.doc_id
"""

_OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS hs FROM w WHERE len(w) >= 50),
u AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM k),
m AS (SELECT h, min(doc_id) AS first FROM u GROUP BY h),
f AS (SELECT doc_id, i FROM u JOIN m USING (h) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f),
o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
t AS (SELECT o.doc_id, count(g.i) AS gone, string_agg(word, ' ' ORDER BY o.i) FILTER (g.i IS NULL) AS kept
      FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.i = o.i GROUP BY o.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""

_OP8 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(10, len(w)) AS m, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' '))) AS h FROM i),
k AS (SELECT doc_id, m, list_transform(range(1, len(w) - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' ')) AS hs
      FROM w, (SELECT DISTINCT m FROM i) WHERE len(w) >= m),
u AS (SELECT doc_id, m, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM k),
f AS (SELECT u.doc_id, u.i, u.m, p.item_id FROM u JOIN p ON p.m = u.m AND p.h = u.h),
g AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS i FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(g.n, 0) > 0 AS contaminated
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": _OP3, "op5_jaccard_join": _OP5, "op6_substring_dedup": _OP6, "op8_decontaminate": _OP8}
