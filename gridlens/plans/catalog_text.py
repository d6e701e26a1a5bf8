"""Queries over text: normalisation, terms, stem coverage, facts and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import fragments
from gridlens.functions import lexicon as L
from gridlens.functions import text as X
from gridlens.operators import facts as facts_ops
from gridlens.operators import lexical
from gridlens.operators.distributed import first_per_key, materialize
from gridlens.plans import text_sql as S
from gridlens.plans.adapters import table, texts, turn_pairs
from gridlens.plans.registry import query


@query("normalized_text", f"SELECT doc_id, md5({S.normalized('text')}) AS digest FROM documents")
def normalized_text(spark, folder):
    return texts(spark, folder).select("doc_id", F.md5(X.normalized(F.col("text"))).alias("digest"))


@query("dedup_norm_text", f"""SELECT doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY {S.normalized('text')} ORDER BY doc_id) = 1""")
def dedup_norm_text(spark, folder):
    """First document of every normalised text; the key is a digest, so texts are not shuffled."""
    keyed = texts(spark, folder).select("doc_id", F.sha2(X.normalized(F.col("text")), 256).alias("norm"))
    return first_per_key(keyed, ["norm"], "doc_id").select("doc_id")


@query("raw_tokens", f"""SELECT doc_id, len({S.raw_tokens('text')}) AS n,
md5(array_to_string({S.raw_tokens('text')}, ' ')) AS digest FROM documents""")
def raw_tokens(spark, folder):
    tokens = texts(spark, folder).select("doc_id", X.raw_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("term_tokens", f"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {S.term_tokens('text')} AS t FROM documents)""")
def term_tokens(spark, folder):
    tokens = texts(spark, folder).select("doc_id", X.term_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


_ANCHORS_SQL = f"""tok AS (
  SELECT doc_id, list_transform({S.content_tokens('text')}, lambda t: {S.canonical('t')}) AS t FROM documents),
neg AS (
  SELECT doc_id, t, flatten(list_transform(range(1, len(t) + 1), lambda i: CASE
    WHEN t[i] IN ({S.quoted(L.NEGATIONS)}) THEN list_transform(t[i + 1:i + 3], lambda x: 'NEG::' || x)
    ELSE [] END)) AS extra FROM tok)"""


@query("anchor_tokens", f"""WITH {_ANCHORS_SQL}
SELECT doc_id, len(extra) AS negated, md5(array_to_string(list_concat(t, extra), ' ')) AS digest FROM neg""")
def anchor_tokens(spark, folder):
    tokens = texts(spark, folder).select("doc_id", X.anchor_tokens(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id", F.size(F.filter("t", lambda x: x.startswith("NEG::"))).cast("bigint").alias("negated"),
        F.md5(F.array_join("t", " ")).alias("digest"))


@query("term_frequency", f"""SELECT doc_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest({S.term_tokens('text')}) AS term FROM documents) GROUP BY 1, 2""")
def term_frequency(spark, folder):
    return lexical.term_frequencies(texts(spark, folder), "doc_id", "text")


_DF_SQL = f"""df AS (SELECT term, count(*) AS df FROM (
  SELECT unnest(list_distinct({S.term_tokens('text')})) AS term FROM documents) GROUP BY 1),
size AS (SELECT count(*) AS n FROM documents)"""


@query("idf_table", f"""WITH {_DF_SQL}
SELECT term, df, round(least(ln((n + 1.0) / (df + 1.0)) + 1, 10.0), 6) AS idf FROM df, size""")
def idf_table(spark, folder):
    documents = texts(spark, folder)
    idf = lexical.smooth_idf(F.lit(float(documents.count())), F.col("df"))
    return lexical.document_frequencies(documents, "text").select("term", "df", F.round(idf, 6).alias("idf"))


@query("reference_frequencies", f"""WITH {_DF_SQL},
terms AS (SELECT DISTINCT unnest({S.term_tokens(S.measurement_stem('text'))}) AS term FROM benchmark)
SELECT term, coalesce(df, 0) AS df FROM terms LEFT JOIN df USING (term)""")
def reference_frequencies(spark, folder):
    terms = lexical.selected_terms(table(spark, folder, "benchmark"), "text")
    return lexical.reference_frequencies(terms, lexical.document_frequencies(texts(spark, folder), "text"))


@query("turn_pairs", """SELECT u.conv_id, u.turn, md5(u.text) AS stem, md5(a.text) AS reply
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def paired_turns(spark, folder):
    return turn_pairs(spark, folder).select("conv_id", "turn", F.md5("stem").alias("stem"), F.md5("facts").alias("reply"))


def scored_turns(spark, folder):
    """Every user turn as a stem; its reply gives the facts and the following reply the implications."""
    documents = texts(spark, folder)
    frequencies = lexical.document_frequencies(documents, "text")
    # Turns are paired once; profiles, term counts and scores all read the stored cells.
    pairs = materialize(turn_pairs(spark, folder))
    later = pairs.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("facts").alias("implications"))
    cells = materialize(pairs.join(later, ["conv_id", "turn"], "left").select(
        F.concat_ws("/", "conv_id", "turn").alias("question_id"), "stem", "facts",
        F.coalesce("implications", F.lit("")).alias("implications")))
    profiles = lexical.stem_profiles(cells.select("question_id", "stem"), frequencies, documents.count())
    return lexical.score_coverage(cells.drop("stem"), profiles)


_TURNS_SQL = f"""{_DF_SQL},
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS stem, a.text AS facts FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
turns AS (
  SELECT p.conv_id::VARCHAR || '/' || p.turn::VARCHAR AS question_id, p.stem, p.facts, coalesce(l.facts, '') AS implications
  FROM pairs p LEFT JOIN pairs l ON l.conv_id = p.conv_id AND l.turn = p.turn + 2),
st AS (SELECT question_id, term, count(*) AS n FROM (
  SELECT question_id, unnest({S.term_tokens(S.measurement_stem('stem'))}) AS term FROM turns) GROUP BY ALL),
ft AS (SELECT question_id, term, count(*) AS n FROM (
  SELECT question_id, unnest({S.term_tokens('facts')}) AS term FROM turns) GROUP BY ALL),
it AS (SELECT question_id, term, count(*) AS n FROM (
  SELECT question_id, unnest({S.term_tokens('implications')}) AS term FROM turns) GROUP BY ALL),
m AS (
  SELECT st.question_id, st.n AS s, coalesce(ft.n, 0) AS f, coalesce(it.n, 0) AS i,
         least(ln(((SELECT n FROM size) + 1.0) / (coalesce(df, 0) + 1.0)) + 1, 10.0) AS idf
  FROM st LEFT JOIN ft USING (question_id, term) LEFT JOIN it USING (question_id, term) LEFT JOIN df USING (term)),
w AS (
  SELECT question_id, idf, (1 + ln(s)) * idf AS ws,
         CASE WHEN least(s, f) > 0 THEN (1 + ln(least(s, f))) * idf ELSE 0 END AS wf,
         CASE WHEN least(s, i) > 0 THEN (1 + ln(least(s, i))) * idf ELSE 0 END AS wi,
         CASE WHEN least(s, f + i) > 0 THEN (1 + ln(least(s, f + i))) * idf ELSE 0 END AS wp,
         CASE WHEN least(s, f, i) > 0 THEN (1 + ln(least(s, f, i))) * idf ELSE 0 END AS wb FROM m),
len AS (SELECT question_id, (len({S.term_tokens('facts')}) + len({S.term_tokens('implications')}))::DOUBLE AS tokens FROM turns),
agg AS (SELECT question_id, sum(ws) AS ws, sum(wf) AS wf, sum(wi) AS wi, sum(wp) AS wp, sum(wb) AS wb,
  sum(ws) FILTER (WHERE idf >= 6) AS hs, sum(wp) FILTER (WHERE idf >= 6) AS hp,
  sum(wb) FILTER (WHERE idf >= 6) AS hb FROM w GROUP BY 1)"""


@query("tfidf_recall", f"""WITH {_TURNS_SQL}
SELECT question_id, round(coalesce(wf / ws, 0), 6) AS facts_tfidf_recall,
       round(coalesce(wi / ws, 0), 6) AS implications_tfidf_recall,
       round(coalesce(wp / ws, 0), 6) AS preanswer_tfidf_recall,
       round(CASE WHEN tokens > 0 THEN 100 * coalesce(wp, 0) / tokens ELSE 0 END, 5) AS density, tokens
FROM len LEFT JOIN agg USING (question_id)""")
def tfidf_recall(spark, folder):
    scored = scored_turns(spark, folder)
    names = ("facts_tfidf_recall", "implications_tfidf_recall", "preanswer_tfidf_recall")
    return scored.select(
        "question_id", *[F.round(n, 6).alias(n) for n in names],
        F.round("preanswer_tfidf_density_per_100_tokens", 5).alias("density"),
        F.col("preanswer_tfidf_token_count").alias("tokens"))


@query("shared_recall", f"""WITH {_TURNS_SQL}
SELECT question_id, round(coalesce(wb / ws, 0), 6) AS shared_recall FROM turns LEFT JOIN agg USING (question_id)""")
def shared_recall(spark, folder):
    return scored_turns(spark, folder).select(
        "question_id", F.round("facts_implications_shared_tfidf_recall", 6).alias("shared_recall"))


@query("high_idf_recall", f"""WITH {_TURNS_SQL}
SELECT question_id, round(coalesce(hp / hs, 0), 6) AS high_recall, round(coalesce(hb / hs, 0), 6) AS shared_high_recall
FROM turns LEFT JOIN agg USING (question_id)""")
def high_idf_recall(spark, folder):
    return scored_turns(spark, folder).select(
        "question_id", F.round("preanswer_high_idf_tfidf_recall", 6).alias("high_recall"),
        F.round("facts_implications_shared_high_idf_recall", 6).alias("shared_high_recall"))


_SPANS_SQL = f"""{_TURNS_SQL},
src AS (SELECT question_id, {S.measurement_stem('stem')} AS source FROM turns),
parts AS (SELECT question_id, unnest(regexp_extract_all(source, {S.literal(L.TOKEN)})) AS surface,
            unnest(string_split_regex(source, {S.literal(L.TOKEN)})) AS gap, unnest(range(len(string_split_regex(source, {S.literal(L.TOKEN)})))) AS place
          FROM src),
placed AS (SELECT *, sum(length(gap) + coalesce(length(surface), 0)) OVER (PARTITION BY question_id ORDER BY place)
             - length(surface) AS start, {S.term_tokens('surface')} AS t FROM parts),
shown AS (SELECT question_id, place, start, start + length(surface) AS stop, t[1] AS term,
            row_number() OVER (PARTITION BY question_id, t[1] ORDER BY place) AS k
          FROM placed WHERE surface IS NOT NULL AND len(t) = 1 AND lower(surface) <> 'not'),
credit AS (SELECT s.*, coalesce(ft.n, 0) AS n1, coalesce(it.n, 0) AS n2 FROM shown s
           LEFT JOIN ft USING (question_id, term) LEFT JOIN it USING (question_id, term)),
spans AS (SELECT *, 'A' AS side FROM credit WHERE k <= n1 UNION ALL SELECT *, 'B' FROM credit WHERE k <= n2)"""


@query("coverage_spans", f"""WITH {_SPANS_SQL}
SELECT question_id, side, start::BIGINT AS start, stop::BIGINT AS "end", term,
       CASE WHEN k <= least(n1, n2) THEN 'common' ELSE 'unique' END AS kind,
       CASE WHEN k > least(n1, n2) THEN round(0.16 + 0.5 * (least(ln(((SELECT n FROM size) + 1.0) / (coalesce(df, 0) + 1.0)) + 1, 10.0) - 1) / 9, 6) END AS opacity
FROM spans LEFT JOIN df USING (term)""")
def coverage_spans(spark, folder):
    """Character spans of user turns that their reply, the following reply, or both take up."""
    documents = texts(spark, folder)
    pairs = materialize(turn_pairs(spark, folder))
    later = pairs.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("facts").alias("second"))
    rows = pairs.join(later, ["conv_id", "turn"], "left").select(
        F.concat_ws("/", "conv_id", "turn").alias("question_id"), "stem", F.col("facts").alias("first"),
        F.coalesce("second", F.lit("")).alias("second"))
    spans = lexical.coverage_spans(rows, lexical.document_frequencies(documents, "text"), documents.count(), key="question_id")
    return spans.withColumn("opacity", F.round("opacity", 6))


def _anchor_sql(text: str) -> str:
    tokens = f"list_transform({S.content_tokens(text)}, lambda t: {S.canonical('t')})"
    return f"""(SELECT question_id, unnest(list_concat(t, flatten(list_transform(range(1, len(t) + 1), lambda i: CASE
      WHEN t[i] IN ({S.quoted(L.NEGATIONS)}) THEN list_transform(t[i + 1:i + 3], lambda x: 'NEG::' || x) ELSE [] END))))
      AS term FROM (SELECT question_id, {tokens} AS t FROM turns))"""


_WEIGHT_SQL = f"""CASE WHEN term LIKE 'NEG::%' OR term IN ({S.quoted(L.NEGATIONS)})
   OR regexp_matches(term, '^[.]*\\p{{Nd}}[\\p{{Nd}}.]*$') THEN 2.0
  WHEN term IN ({S.quoted(L.LATERALITY + L.TIMING)}) OR term LIKE '%\\%' ESCAPE '\\' THEN 1.5 ELSE 1.0 END"""


@query("anchor_recall", f"""WITH {_TURNS_SQL},
sa AS (SELECT question_id, term, count(*) AS n, {_WEIGHT_SQL} AS w FROM {_anchor_sql(S.measurement_stem('stem'))} GROUP BY ALL),
fa AS (SELECT question_id, term, count(*) AS n FROM {_anchor_sql('facts')} GROUP BY ALL),
ia AS (SELECT question_id, term, count(*) AS n FROM {_anchor_sql('implications')} GROUP BY ALL),
pa AS (SELECT question_id, term, count(*) AS n FROM {_anchor_sql("facts || ' ' || implications")} GROUP BY ALL),
j AS (SELECT sa.question_id, w, sa.n AS s, coalesce(fa.n, 0) AS f, coalesce(ia.n, 0) AS i, coalesce(pa.n, 0) AS p
  FROM sa LEFT JOIN fa USING (question_id, term) LEFT JOIN ia USING (question_id, term)
  LEFT JOIN pa USING (question_id, term)),
g AS (SELECT question_id, sum(w * least(s, f)) / sum(w * s) AS a, sum(w * least(s, i)) / sum(w * s) AS b,
  sum(w * least(s, p)) / sum(w * s) AS c, sum(w * least(s, f, i)) / sum(w * s) AS d FROM j GROUP BY 1)
SELECT question_id, round(coalesce(a, 0), 6) AS facts_anchor_recall, round(coalesce(b, 0), 6) AS implications_anchor_recall,
  round(coalesce(c, 0), 6) AS preanswer_anchor_recall, round(coalesce(d, 0), 6) AS shared_anchor_recall
FROM turns LEFT JOIN g USING (question_id)""")
def anchor_recall(spark, folder):
    names = ("facts_anchor_recall", "implications_anchor_recall", "preanswer_anchor_recall", "shared_anchor_recall")
    return scored_turns(spark, folder).select("question_id", *[F.round(n, 6).alias(n) for n in names])


_BAGS_SQL = f"""l AS (SELECT lang, term, count(*) AS n FROM (
  SELECT lang, unnest({S.term_tokens('text')}) AS term FROM documents WHERE substr(source, 4)::INT % 2 = 0) GROUP BY ALL),
r AS (SELECT lang, term, count(*) AS n FROM (
  SELECT lang, unnest({S.term_tokens('text')}) AS term FROM documents WHERE substr(source, 4)::INT % 2 = 1) GROUP BY ALL)"""


def term_bags(spark, folder):
    """Terms of the even and of the odd sources; together they hold every document."""
    documents = texts(spark, folder)
    bags = []
    for side in (0, 1):
        terms = documents.filter(F.substring("source", 4, 10).cast("int") % 2 == side).select(
            "lang", F.explode(X.term_tokens(F.col("text"))).alias("term"))
        bags.append(terms.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")))
    return bags


@query("multiset_difference", f"""WITH {_BAGS_SQL}
SELECT lang, term, l.n - coalesce(r.n, 0) AS n FROM l LEFT JOIN r USING (lang, term) WHERE l.n > coalesce(r.n, 0)""")
def multiset_difference(spark, folder):
    return lexical.multiset_only_left(*term_bags(spark, folder), ["lang", "term"], "n")


@query("multiset_intersection", f"""WITH {_BAGS_SQL} SELECT lang, term, least(l.n, r.n) AS n FROM l JOIN r USING (lang, term)""")
def multiset_intersection(spark, folder):
    return lexical.multiset_common(*term_bags(spark, folder), ["lang", "term"], "n")


@query("multiset_sum", f"""WITH {_BAGS_SQL}
SELECT lang, term, sum(n)::BIGINT AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY ALL""")
def multiset_sum(spark, folder):
    return lexical.multiset_sum(*term_bags(spark, folder), ["lang", "term"], "n")


@query("informative_filter", f"""WITH t AS (SELECT doc_id, {S.content_tokens('text')} AS t FROM documents),
c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, term, count(*) AS n FROM (
  SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL) GROUP BY 1)
SELECT t.doc_id, len(t) >= 6 AND len(list_distinct(t)) >= 4 AND coalesce(top::DOUBLE / len(t) <= 0.5, false) AS informative
FROM t LEFT JOIN c USING (doc_id)""")
def informative_filter(spark, folder):
    tokens = texts(spark, folder).select("doc_id", X.content_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", X.informative(F.col("t"), 6).alias("informative"))


# RE2 has no look-behind: mark the break after the punctuation, then split at the mark.
def _sentences_sql(text: str) -> str:
    marked = f"regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    parts = f"string_split_regex({marked}, chr(1) || '|\\n+')"
    return f"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query("sentence_split", f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest
FROM (SELECT doc_id, {_sentences_sql('text')} AS s FROM documents)""")
def sentence_split(spark, folder):
    split = texts(spark, folder).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def _feature_sql(words) -> str:
    return f"array_to_string(list_sort(list_filter(list_distinct(t), lambda x: x IN ({S.quoted(words)}))), ',')"


@query("hard_features", f"""SELECT doc_id,
  array_to_string(list_sort(list_transform(regexp_extract_all(text, {S.literal(L.NUMBER)}),
    lambda n: replace(lower(n), ' ', ''))), ',') AS numbers, {_feature_sql(L.FACT_NEGATION)} AS negation,
  {_feature_sql(L.FACT_LATERALITY)} AS laterality, {_feature_sql(L.FACT_TIMING)} AS timing,
  {_feature_sql(L.FACT_DIRECTION)} AS direction
FROM (SELECT doc_id, text, {S.fact_tokens('text')} AS t FROM documents)""")
def hard_features(spark, folder):
    found = texts(spark, folder).select("doc_id", X.hard_features(F.col("text")).alias("f"))
    return found.select("doc_id", *[
        F.coalesce(F.array_join(F.col("f")[k], ","), F.lit("")).alias(k) for k in X.FEATURE_KINDS])


@query("fact_tokens", f"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {S.fact_tokens('text')} AS t FROM documents)""")
def fact_tokens(spark, folder):
    tokens = texts(spark, folder).select("doc_id", X.fact_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("fact_inventory")
def fact_inventory(spark, folder):
    """Facts and review flags of every benchmark question and user turn."""
    stems = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("question_id"),
                                                     F.col("text").alias("stem"))
    turns = turn_pairs(spark, folder).select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), "stem")
    inventory = facts_ops.fact_inventory(stems.unionByName(turns))
    return facts_ops.question_review(inventory.withColumn("gold_raw", F.lit(None).cast("string"))).drop("stem")


@query("fact_coverage")
def fact_coverage(spark, folder):
    """How far replies keep the facts of the user turn they answer."""
    cells = turn_pairs(spark, folder).select(
        F.concat_ws("/", "conv_id", "turn").alias("question_id"), "stem", "facts", F.col("facts").alias("implications"))
    return facts_ops.score_facts(facts_ops.fact_inventory(cells)).drop("stem", "facts", "implications", "facts_list")


@query("plain_text_html", """SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(html, '(?s)</?[\\p{L}_][\\p{L}\\p{N}_.:-]*(?:\\s+[^<>]*?)?\\s*/?>', ' ', 'g'),
  '(?i)```(?:xml|markdown|md|text)?', ' ', 'g'), '\\*\\*|__|~~|`+', '', 'g'), '&(amp|copy|middot|nbsp|lt|gt|quot);', '?', 'g'),
  '\\s+', ' ', 'g'))) AS digest FROM pages""")
def plain_text_html(spark, folder):
    """Markup flattening with entities left to a placeholder, since SQL has no entity table."""
    def placeholder(text):
        return F.regexp_replace(text, "&(amp|copy|middot|nbsp|lt|gt|quot);", "?")

    return texts(spark, folder, "pages", "page_id").select(
        "page_id", F.md5(X.plain_text(F.col("html"), placeholder)).alias("digest"))


@query("visible_page_text")
def visible_page_text(spark, folder):
    return texts(spark, folder, "pages", "page_id").select("page_id", X.plain_text(F.col("html")).alias("text"))


@query("heading_counts", """SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6]\\b[^<>]*>')) AS headings,
  len(regexp_extract_all(html, '(?i)<p\\b[^<>]*>')) AS paragraphs FROM pages""")
def heading_counts(spark, folder):
    def tags(pattern):
        return F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("bigint")

    return texts(spark, folder, "pages", "page_id").select(
        "page_id", tags(r"(?i)<h[1-6]\b[^<>]*>").alias("headings"), tags(r"(?i)<p\b[^<>]*>").alias("paragraphs"))


@query("markdown_stripped", """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)^[ \\t]{0,3}#{1,6}[ \\t]*', '', 'g'),
  '\\*\\*|__|~~|`+', '', 'g')) AS digest FROM documents""")
def markdown_stripped(spark, folder):
    return texts(spark, folder).select("doc_id", F.md5(X.strip_markdown(F.col("text"))).alias("digest"))


def protocol_cells(spark, folder):
    """Cells whose responses follow the protocol headings, put together from whole replies and stems.

    Options, decision and a left-out role vary with the conversation and turn.
    """
    pairs = turn_pairs(spark, folder)
    tokens = F.split(F.trim(F.regexp_replace("stem", r"\s+", " ")), " ")

    def every_fourth(start):
        return F.array_join(F.filter(tokens, lambda _, place: place % 4 == start), " ")

    choices = F.array(*[F.struct(F.lit(label).alias("label"), every_fourth(i).alias("text")) for i, label in enumerate("ABCD")])
    letter = lambda place: F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (place % 4 + 1).cast("int"))
    first, second, last = letter(F.col("conv_id")), letter(F.col("conv_id") + 1), letter(F.col("conv_id") + F.col("turn"))
    kept = F.col("turn") % 4 == 0
    # On one line: a line of the text that begins with a letter and a mark would name an option itself.
    facts, stem = (F.regexp_replace(c, r"\s+", " ") for c in ("facts", "stem"))
    content = F.concat_ws(
        "\n", F.lit("1. Facts"), "stem", F.lit("2. Implications"), "facts", F.lit("3. Provisional answer"),
        F.concat(F.lit("Option "), first, F.lit(" because "), facts), F.lit("4. Best alternative"),
        F.concat(F.lit("Option "), second, F.lit(" but less likely given "), stem),
        F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("5. Decisive distinction\n"), F.col("stem"))),
        F.lit("6. What would change the answer"), F.concat(F.lit("If the finding were absent, option "), second, F.lit(" would become best.")),
        F.lit("7. Reconsideration"),
        F.concat(F.when(kept, "Retain option ").otherwise("Revise to option "), last, F.lit(" since "), stem),
        F.lit("8. Final answer"), F.concat(F.lit("Option "), last))
    return pairs.select(
        F.concat_ws("/", "conv_id", "turn").alias("question_id"), F.concat_ws("/", "conv_id", "turn").alias("cell_id"),
        F.lit("m0").alias("model_id"), F.when(F.col("turn") == 6, "zero").otherwise("system").alias("condition_id"),
        F.lit("turns").alias("dataset"), F.when(F.col("conv_id") % 7 == 0, "failed").otherwise("completed").alias("status"),
        "stem", choices.alias("choices"), F.lit("A").alias("gold"), content.alias("content"))


@query("judge_cells")
def judge_cells(spark, folder):
    """Full judgments of protocol responses."""
    from gridlens.operators import judge as judging

    documents = texts(spark, folder)
    cells = facts_ops.fact_inventory(protocol_cells(spark, folder))
    profiles = lexical.stem_profiles(cells.select("question_id", "stem"),
                                     lexical.document_frequencies(documents, "text"), documents.count())
    return judging.judge(cells, profiles)


@query("recovered_sections", """SELECT u.conv_id || '/' || u.turn AS cell_id,
  CASE WHEN u.conv_id % 5 = 0 THEN 7 ELSE 8 END AS roles, u.conv_id % 5 > 0 AS ordered,
  substr('ABCD', (u.conv_id + u.turn) % 4 + 1, 1) AS final_option,
  CASE WHEN u.turn % 4 = 0 THEN 'retain' ELSE 'revise' END AS decision,
  substr('ABCD', u.conv_id % 4 + 1, 1) AS provisional, substr('ABCD', (u.conv_id + 1) % 4 + 1, 1) AS alternative
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'""")
def recovered_sections(spark, folder):
    """Roles, options and decision of protocol responses."""
    from gridlens.operators.sections import recover

    found = recover(protocol_cells(spark, folder))
    return found.select(
        "cell_id", F.size(F.filter("role_counts", lambda n: n >= 1)).alias("roles"), "ordered",
        F.col("recovered_final_option").alias("final_option"), "decision", F.col("provisional_option").alias("provisional"),
        F.col("second_best_option").alias("alternative"))


def _sql_stem(word: str) -> str:
    return f"""CASE WHEN length({word}) > 6 AND {word} LIKE '%ing' THEN {word}[:-4]
      WHEN length({word}) > 5 AND {word} LIKE '%ies' THEN {word}[:-4] || 'y'
      WHEN length({word}) > 5 AND {word} LIKE '%ed' THEN {word}[:-3]
      WHEN length({word}) > 4 AND {word} LIKE '%s' AND {word} NOT LIKE '%ss' THEN {word}[:-2] ELSE {word} END"""


@query("choice_fragments", f"""WITH pairs AS (
  SELECT u.conv_id || '/' || u.turn AS cell_id, u.conv_id + u.turn AS n, string_split({S.normalized('u.text')}, ' ') AS t
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
places AS (SELECT cell_id, n, unnest(range(len(t))) AS p, t FROM pairs),
words AS (SELECT cell_id, n, p, t[p + 1] AS w, p % 4 AS choice, p // 4 AS place FROM places WHERE t[p + 1] <> ''),
said AS (SELECT DISTINCT cell_id, {_sql_stem('w')} AS w FROM (
  SELECT cell_id, CASE WHEN length(w) > 3 THEN w || 's' ELSE w END AS w FROM words
  WHERE (choice = n % 4 AND place % 7 <> 6) OR (choice = (n + 1) % 4 AND place % (2 + n % 3) = 1))),
stems AS (SELECT DISTINCT cell_id, choice, {_sql_stem('w')} AS w FROM words),
wording AS (SELECT cell_id, choice, count(s.w) AS said, count(*) AS size FROM stems LEFT JOIN said s USING (cell_id, w)
  GROUP BY ALL HAVING bool_or(stems.w NOT IN ('n', 'a'))),
best AS (SELECT a.cell_id, a.choice FROM wording a WHERE 100 * a.said >= 80 * a.size AND NOT EXISTS (
  SELECT 1 FROM wording b WHERE b.cell_id = a.cell_id AND b.choice <> a.choice
  AND 100 * (a.said * b.size - b.said * a.size) <= 15 * a.size * b.size)),
own AS (SELECT cell_id, min(choice) AS choice, w FROM stems GROUP BY cell_id, w HAVING count(*) = 1),
told AS (SELECT * FROM own WHERE w NOT IN ({S.quoted(fragments.EMPTY_WORDS)}) AND (length(w) >= 3 OR regexp_matches(w, '[0-9]'))),
counted AS (SELECT cell_id, choice, count(s.w) AS said, count(*) AS size,
  bool_or(s.w IS NOT NULL AND (length(told.w) >= 8 OR regexp_matches(told.w, '[0-9]'))) AS alone
  FROM told LEFT JOIN said s USING (cell_id, w) GROUP BY ALL),
sized AS (SELECT * FROM counted WHERE said >= 2 OR (said = 1 AND size = 1 AND alone)),
ahead AS (SELECT a.cell_id, a.choice FROM sized a WHERE NOT EXISTS (
  SELECT 1 FROM sized b WHERE b.cell_id = a.cell_id AND b.choice <> a.choice AND NOT (a.said >= b.said + 2
  OR (a.said > b.said AND 100 * (a.said * b.size - b.said * a.size) >= 35 * a.size * b.size))))
SELECT p.cell_id, substr('ABCD', CAST(best.choice + 1 AS BIGINT), 1) AS wording,
  substr('ABCD', CAST(ahead.choice + 1 AS BIGINT), 1) AS own_words
FROM pairs p LEFT JOIN best ON best.cell_id = p.cell_id LEFT JOIN ahead ON ahead.cell_id = p.cell_id""")
def choice_fragments(spark, folder):
    """Choices that prose without labels is about; it holds most words of one choice, inflected, and some of another."""
    pairs = turn_pairs(spark, folder).select(
        F.concat_ws("/", "conv_id", "turn").alias("cell_id"), (F.col("conv_id") + F.col("turn")).alias("n"),
        F.split(X.normalized(F.col("stem")), " ").alias("t"))
    letters = F.array(*[F.lit(x) for x in "ABCD"])

    def every_fourth(start):
        return F.filter("t", lambda _, p: p % 4 == start)

    dealt = pairs.select("cell_id", "n", F.array(*[every_fourth(k) for k in range(4)]).alias("parts"))

    def inflected(words):
        return F.transform(words, lambda w: F.when(F.length(w) > 3, F.concat(w, F.lit("s"))).otherwise(w))

    first = F.filter(F.get("parts", (F.col("n") % 4).cast("int")), lambda _, p: p % 7 != 6)
    second = F.filter(F.get("parts", ((F.col("n") + 1) % 4).cast("int")), lambda _, p: p % (F.col("n") % 3 + 2) == 1)
    choice_texts = F.transform("parts", lambda words: F.array_join(words, " "))
    read = dealt.select("cell_id", fragments.stems(F.array_join(inflected(F.concat(first, second)), " ")).alias("said"),
                        fragments.profiles(letters, choice_texts).alias("profiles"))
    return read.select("cell_id", fragments.by_wording(F.col("said"), F.col("profiles")).alias("wording"),
                       fragments.by_own_words(F.col("said"), F.col("profiles")).alias("own_words"))
