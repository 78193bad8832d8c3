"""One query per operator over the given tables, and SQL twins where SQL can say it.

Without a twin: op1, op9 (fitted models), op3 (spans of the randomness tests), op5
(approximate search), op6, op10 (hashed orders, curve numbers), op7, op12 (BPE) and op13
(eigenvectors). The tests in `tests/llm` hold these against brute force.
"""

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.llm import (
    alignment,
    block_naming,
    decontamination,
    hilbert,
    mixing,
    quality,
    rp_forest,
    secret_scan,
    signature_join,
    toxicity,
    trie_bpe,
    url_filter,
    whitening,
)
from levelmark.llm.common import ROW_KEYS, table

#: Vocabulary files; others by the environment.
VOCABULARY = os.environ.get("LEVELMARK_VOCABULARY") or public_tokenizers.path("word_bpe_49k.json")

ALIGNED_A = os.environ.get("LEVELMARK_VOCABULARY_A") or public_tokenizers.path("byte_bpe_50k.json")
ALIGNED_B = os.environ.get("LEVELMARK_VOCABULARY_B") or public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES)


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, folder, "documents")).drop(*ROW_KEYS, "spare")


def op5_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return rp_forest.search(table(spark, folder, "embeddings"))


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mixture(table(spark, folder, "documents"))
    taken = (F.col("size") * F.size("draws")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken, "draws")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return trie_bpe.digests(table(spark, folder, "documents"), VOCABULARY)


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.similar_documents(table(spark, folder, "documents")).drop(*ROW_KEYS)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.shard_layout(table(spark, folder, "documents")).drop(*ROW_KEYS)


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digests(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digests(table(spark, folder, "documents"), ALIGNED_A, ALIGNED_B)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_url_filter,
        op3_secret_scan,
        op4_exact_dedup,
        op5_nearest_vectors,
        op6_source_mix,
        op7_bpe,
        op8_ngram_join,
        op9_toxicity,
        op10_hilbert_shards,
        op11_decontamination,
        op12_token_alignment,
        op13_whitening,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
         ('com/fr/', 'allow'), ('com/de/', 'block')),
split AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM rules),
ranked AS (
  SELECT p.*, s.rule, coalesce(s.verdict, 'allow') AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(s.rule) DESC NULLS LAST, length(s.rule_host) DESC) AS n
  FROM parsed p LEFT JOIN split s
    ON (p.host = s.rule_host OR ends_with(p.host, '.' || s.rule_host)) AND starts_with(p.path, s.rule_path))
SELECT page_id, host, path, rule, verdict FROM ranked WHERE n = 1
"""

_COPIES_SQL = f"""
WITH lowered AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM lowered WINDOW same AS (PARTITION BY norm)
"""

_NGRAM_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS g
  FROM words),
sets AS (
  SELECT list_sort(g) AS g, len(g) AS n, min(doc_id) AS node FROM grams GROUP BY ALL),
held AS (
  SELECT node, n, unnest(g) AS gram FROM sets),
pairs AS (
  SELECT a.node AS x, b.node AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS shared
  FROM held a JOIN held b ON a.gram = b.gram AND a.node < b.node
   AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY a.node, b.node),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (m + n - shared)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x AS node, min(y) AS root FROM reach GROUP BY x)
SELECT d.doc_id, len(d.g) AS n_shingles,
       CASE WHEN len(d.g) = 0 THEN d.doc_id ELSE least(s.node, coalesce(l.root, s.node)) END AS component_id
FROM grams d JOIN sets s ON list_sort(d.g) = s.g LEFT JOIN least l USING (node)
"""

_LEAKS_SQL = f"""
WITH items AS (
  SELECT coalesce(item_id::varchar, '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
         FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS win
  FROM items WHERE len(w) > 0),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lists AS (
  SELECT r, k, [array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)] AS wins
  FROM docs CROSS JOIN (SELECT DISTINCT k FROM windows) sizes WHERE len(w) >= k),
grams AS (SELECT r, k, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM lists),
found AS (SELECT r, i, k, item FROM grams JOIN windows USING (k, win)),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS all_items FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

ORACLES: dict[str, str] = {
    "op2_url_filter": _URL_SQL,
    "op4_exact_dedup": _COPIES_SQL,
    "op8_ngram_join": _NGRAM_SQL,
    "op11_decontamination": _LEAKS_SQL,
}
