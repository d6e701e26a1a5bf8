"""Registered queries of the subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import (
    bpe,
    decontaminate,
    line_rules,
    minhash,
    ngram_join,
    phrases,
    quality,
    quotations,
    substring_dedup,
    token_files,
    toxicity,
    url_filter,
    whitening,
)
from gridlens.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op8_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"))


@_query
def op3_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op3_winnowing"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, item_id, places.n, s FROM places JOIN windows USING (n, t)),
per_doc AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY 1),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN per_doc USING (doc_id) LEFT JOIN hit_words USING (doc_id)"""


@_query
def op5_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, folder, "labels")))


@_query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similarity_groups(table(spark, folder, "documents"))


ORACLES["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reached AS (
  SELECT doc_id AS source_id, doc_id AS node_id FROM words
  UNION
  SELECT source_id, y FROM reached JOIN links ON node_id = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT source_id AS doc_id, min(node_id) AS component_id FROM reached GROUP BY 1) USING (doc_id)"""


@_query
def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


# The rules of the registered query.
URL_RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
             url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
             url_filter.Rule("block", "com", "/de/")]


@_query
def op1_redirect_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES).drop("by_alias")


ORACLES["op1_redirect_equivalence"] = r"""
WITH RECURSIVE rules(rule, verdict, host, path) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE html IS NOT NULL AND url IS NOT NULL),
targets AS (
  SELECT url, replace(trim(CASE
    WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^\s"''>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^\s"''>]+)', 1)
    ELSE '' END), '&amp;', '&') AS target FROM tags),
resolved AS (
  SELECT url AS source, CASE
    WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) || target END AS target
  FROM targets WHERE target <> '' AND NOT starts_with(target, '#')),
nodes AS (
  SELECT regexp_extract(source, '(?s)^([^#]*)', 1) AS source, regexp_extract(target, '(?s)^([^#]*)', 1) AS target FROM resolved),
links AS (SELECT source AS x, target AS y FROM nodes UNION SELECT target, source FROM nodes),
parts AS (
  SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url AS u FROM pages UNION SELECT x FROM links)),
ruled AS (
  SELECT u, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts JOIN rules r ON (parts.host = r.host OR ends_with(parts.host, '.' || r.host)) AND starts_with(parts.path, r.path) GROUP BY u),
reached AS (SELECT x AS source_id, y AS node_id FROM links UNION SELECT source_id, y FROM reached JOIN links ON node_id = x),
blocked AS (SELECT DISTINCT source_id FROM reached JOIN ruled ON u = node_id WHERE verdict = 'block')
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN source_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN parts ON parts.u = url LEFT JOIN ruled ON ruled.u = url
LEFT JOIN blocked ON source_id = regexp_extract(url, '(?s)^([^#]*)', 1)"""


@_query
def op9_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.line_first(table(spark, folder, "documents")).drop("cleaned")


@_query
def op2_seekable_token_files(spark: SparkSession, folder: str) -> DataFrame:
    where, manifest = token_files.write_token_files(table(spark, folder, "documents"))
    return token_files.read_token_files(where, manifest)


@_query
def op10_quadratic_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op4_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    found = quotations.link_quotations(table(spark, folder, "conversations"))
    return found.withColumn("quotes", F.to_json("quotes"))


@_query
def op11_minhash_bayes(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


ORACLES["op11_minhash_bayes"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reached AS (
  SELECT doc_id AS source_id, doc_id AS node_id FROM words
  UNION
  SELECT source_id, y FROM reached JOIN links ON node_id = x),
smallest AS (SELECT source_id AS doc_id, min(node_id) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN smallest USING (doc_id)"""


@_query
def op12_chebyshev_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@_query
def op13_phrase_quicksort(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


ORACLES["op13_phrase_quicksort"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM words),
grams AS (SELECT lang, m, w[s:s + m - 1] AS p FROM places, (SELECT unnest(range(1, 6)) AS m) WHERE s + m - 1 <= len(w)),
counts AS (SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT lang, f, p[1:m - 1] AS p FROM counts WHERE m > 2 UNION SELECT lang, f, p[2:m] FROM counts WHERE m > 2),
kept AS (SELECT * FROM counts WHERE m > 1 AND NOT EXISTS (FROM inside i WHERE i.lang = counts.lang AND i.p = counts.p AND i.f >= counts.f)),
cuts AS (SELECT lang, p, m, f AS a, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k]
  JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m]),
best AS (SELECT *, array_to_string(p, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""
