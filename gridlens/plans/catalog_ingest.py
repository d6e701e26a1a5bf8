"""Queries over question ingestion, prior use, human agreement and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions.choices import question_text
from gridlens.operators import agreement, grid
from gridlens.plans import text_sql as S
from gridlens.plans.adapters import dealt, table, texts
from gridlens.plans.catalog_ledger import state_events, state_events_of
from gridlens.plans.registry import ORACLES, query
from gridlens.sources import questions as Q
from gridlens.streaming import events as E


def raw_questions(spark, folder):
    """Questions about parts in eight raw shapes: six choice encodings, a missing stem and a gold conflict."""
    a, b, c = F.col("p_brand"), F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))
    shape = (F.col("p_partkey") % 8).cast("int")
    pair = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    options = (
        F.when(shape.isin(0, 6), F.to_json(F.struct(a.alias("A"), b.alias("B"), c.alias("C"))))
        .when(shape == 1, F.to_json(F.array(a, b, c)))
        .when(shape == 2, F.to_json(F.array(pair("A", a), pair("B", b), pair("C", c))))
        .when(shape == 3, F.to_json(F.struct(F.array(F.lit("A"), F.lit("B"), F.lit("C")).alias("label"),
                                             F.array(a, b, c).alias("text"))))
        .when(shape == 4, F.concat(F.lit("A. "), a, F.lit("\nB. "), b, F.lit("\nC. "), c))
        .when(shape == 5, F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("', '"), c, F.lit("']")))
        .otherwise(F.to_json(F.array(a, b, c)))
    )
    raw = F.to_json(F.struct(
        F.when(shape != 6, F.concat(F.lit("Which  fits "), F.col("p_name"), F.lit("?"))).alias("question"),
        options.alias("options"), F.col("p_partkey").alias("id"),
        F.when(shape.isin(0, 1), 2).alias("answer_idx"),
        F.when(shape.isin(2, 6), "B").when(shape == 3, b).when(shape == 4, "Option 3").when(shape == 5, "1").when(
            shape == 7, "A").alias("answer"),
        F.when(shape == 7, "B").alias("correct_answer")))
    return dealt(spark, folder, "part", "p_partkey").select(F.parse_json(raw).alias("raw"), F.col("p_partkey").alias("row_index"))


def normalized_questions(spark, folder):
    return Q.normalize_questions(raw_questions(spark, folder), F.lit("parts"), F.lit("test"))


_GOLD_SQL = """CASE p_partkey % 8 WHEN 0 THEN 'C' WHEN 1 THEN 'C' WHEN 2 THEN 'B' WHEN 3 THEN 'B' WHEN 4 THEN 'C'
  WHEN 5 THEN 'A' WHEN 6 THEN 'B' END"""
_REASON_SQL = "CASE p_partkey % 8 WHEN 6 THEN 'missing stem' WHEN 7 THEN 'conflicting gold fields' END"


@query("normalize_questions", f"""SELECT 'parts:' || p_partkey AS id,
  CASE WHEN p_partkey % 8 <> 6 THEN 'Which fits ' || p_name || '?' END AS stem, {_GOLD_SQL} AS gold,
  CASE {_GOLD_SQL} WHEN 'A' THEN p_brand WHEN 'B' THEN p_type WHEN 'C' THEN 'size ' || p_size END AS gold_text,
  p_brand || '|' || p_type || '|size ' || p_size AS options, {_REASON_SQL} AS reject_reason FROM part""")
def normalize_questions(spark, folder):
    found = normalized_questions(spark, folder)
    return found.select("id", "stem", "gold", "gold_text", F.array_join(
        F.transform("choices", lambda c: c["text"]), "|").alias("options"), "reject_reason")


@query("rejection_histogram", f"""SELECT reject_reason, count(*) AS n FROM (SELECT {_REASON_SQL} AS reject_reason FROM part)
WHERE reject_reason IS NOT NULL GROUP BY 1""")
def rejection_histogram(spark, folder):
    return Q.rejection_histogram(normalized_questions(spark, folder)).select("reject_reason", "n")


@query("question_rules", """SELECT 'parts:' || p_partkey AS row_id, 'stem_length_odd' AS rule FROM part
WHERE p_partkey % 8 NOT IN (6, 7) AND length('Which fits ' || p_name || '?') % 2 = 0""")
def question_rules(spark, folder):
    """Domain rules of accepted questions hold; one extra rule is broken on purpose."""
    accepted = Q.accept(normalized_questions(spark, folder))
    normalized = F.transform("choices", lambda c: F.lower(c["text"]))
    rules = {**grid.question_rules(normalized), "stem_length_odd": F.length("stem") % 2 == 1}
    return grid.violations(accepted, "id", rules)


@query("rendered_questions", """SELECT 'parts:' || p_partkey AS id, md5('Question' || chr(10) || 'Which fits ' || p_name || '?'
  || chr(10) || chr(10) || 'Answer choices' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10)
  || 'C. size ' || p_size) AS digest FROM part WHERE p_partkey % 8 NOT IN (6, 7)""")
def rendered_questions(spark, folder):
    accepted = Q.accept(normalized_questions(spark, folder))
    return accepted.select("id", F.md5(question_text(F.col("stem"), F.col("choices"))).alias("digest"))


def _block_questions(spark, folder):
    """Questions about parts whose stem repeats the choices: exactly, in other case, in part, in another order, with a wrong text, or not."""
    a, b, c = F.col("p_brand"), F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))
    kind = (F.col("p_partkey") % 6).cast("int")
    item = lambda label, text: F.concat(F.lit(f" ({label}) "), text)
    block = (
        F.when(kind == 0, F.concat(item("A", a), item("B", b), item("C", c)))
        .when(kind == 1, F.concat(item("a", F.lower(a)), item("b", F.lower(b)), item("c", F.upper(c))))
        .when(kind == 2, F.concat(item("A", a), item("B", b)))
        .when(kind == 3, F.concat(item("B", b), item("A", a), item("C", c)))
        .when(kind == 4, F.concat(item("A", a), item("B", F.lit("something else")), item("C", c)))
    )
    stem = F.concat(F.lit("Which fits "), F.col("p_name"), F.lit("?"), F.coalesce(F.concat(F.lit("\nAnswer  Choices:"), block), F.lit("")))
    raw = F.to_json(F.struct(stem.alias("question"), F.struct(a.alias("A"), b.alias("B"), c.alias("C")).alias("options"), F.col("p_partkey").alias("id"),
                             F.lit("B").alias("answer_idx")))
    return dealt(spark, folder, "part", "p_partkey").select(F.parse_json(raw).alias("raw"), F.col("p_partkey").alias("row_index"))


@query("embedded_choices", """WITH k AS (SELECT *, p_partkey % 6 AS kind, 'Which fits ' || p_name || '?' AS bare,
  'size ' || p_size AS c FROM part)
SELECT 'parts:' || p_partkey AS id, CASE kind WHEN 2 THEN bare || ' Answer Choices: (A) ' || p_brand || ' (B) ' || p_type
    WHEN 3 THEN bare || ' Answer Choices: (B) ' || p_type || ' (A) ' || p_brand || ' (C) ' || c
    WHEN 4 THEN bare || ' Answer Choices: (A) ' || p_brand || ' (B) something else (C) ' || c ELSE bare END AS stem,
  CASE WHEN p_partkey % 4 < 2 AND kind > 1 THEN 'no block that mirrors the choices' END AS reject_reason FROM k""")
def embedded_choices(spark, folder):
    """Blocks of choices inside stems are cut off only if they mirror the options; half of the parts come from a source that must have one."""
    found = Q.normalize_questions(_block_questions(spark, folder), F.lit("parts"), F.lit("test"), F.col("row_index") % 4 < 2)
    return found.select("id", "stem", "reject_reason")


def _ledger_lines(spark, folder):
    """Ledgers of earlier runs written from the parts, in every layout; the fourth holds the second's lines once more, in other files."""
    import uuid

    from gridlens.session import ensure_checkpoint_dir
    from gridlens.sources import ledgers

    base = f"{ensure_checkpoint_dir(spark)}/ledgers-{uuid.uuid4()}"
    parts = table(spark, folder, "part")
    stem = F.concat(F.lit("Which fits "), F.col("p_name"), F.lit("?"))
    block = F.concat(F.lit(" Answer Choices: (A) "), F.col("p_brand"), F.lit(" (B) "), F.col("p_type"))
    line = lambda stem: F.to_json(F.struct(
        F.concat(F.lit("parts:"), F.col("p_partkey")).alias("id"), F.element_at(F.split("p_type", " "), -1).alias("dataset"), stem.alias("stem"),
        F.struct(F.col("p_brand").alias("A"), F.col("p_type").alias("B")).alias("choices"))).alias("value")
    frames = [parts.filter("p_partkey % 3 = 0").select(line(stem)), parts.filter("p_partkey % 2 = 0").select(line(F.concat(stem, block))),
              parts.filter("p_size > 25").select(line(stem)), parts.filter("p_partkey % 2 = 0").select(line(F.concat(stem, block))).repartition(3)]
    for i, (frame, place) in enumerate(zip(frames, ledgers.PLACES)):
        frame.write.text(f"{base}/run{i}/{place}")
    return ledgers.read_ledgers(spark, [f"{base}/run{i}" for i in range(4)])


@query("ledger_union", """WITH e AS (
  SELECT 0 AS ledger_index, * FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 1, * FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 2, * FROM part WHERE p_size > 25),
i AS (SELECT k AS ledger_index, count(*) AS new_ids FROM (SELECT min(ledger_index) AS k FROM e GROUP BY p_partkey) GROUP BY 1),
s AS (SELECT k AS ledger_index, count(*) AS new_stems FROM (SELECT min(ledger_index) AS k FROM e GROUP BY p_name) GROUP BY 1)
SELECT e.ledger_index, count(*) AS rows, string_agg(DISTINCT split_part(p_type, chr(32), -1), chr(44) ORDER BY split_part(p_type, chr(32), -1)) AS datasets,
       any_value(coalesce(new_ids, 0)) AS new_ids, any_value(coalesce(new_stems, 0)) AS new_stems
FROM e LEFT JOIN i USING (ledger_index) LEFT JOIN s USING (ledger_index) GROUP BY 1""")
def ledger_union(spark, folder):
    from gridlens.sources import ledgers

    audit = ledgers.ledger_audit(ledgers.unite_ledgers(_ledger_lines(spark, folder)))
    return audit.select("ledger_index", "rows", "datasets", "new_ids", "new_stems")


def _documents(spark, folder):
    documents = texts(spark, folder).select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("id"),
                                            "text", "source")
    return Q.with_stem_key(documents, "text").drop("text")


@query("exclude_prior", f"""SELECT doc_id::VARCHAR AS id FROM documents
WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
  AND {S.normalized('text')} NOT IN (SELECT {S.normalized('text')} FROM benchmark)""")
def exclude_prior(spark, folder):
    ledger = Q.with_stem_key(table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), "text"), "text")
    return Q.exclude_used(_documents(spark, folder), ledger).select("id")


@query("cross_source_dedup", f"""SELECT doc_id::VARCHAR AS id, source FROM documents
QUALIFY dense_rank() OVER (PARTITION BY {S.normalized('text')} ORDER BY source) = 1""")
def cross_source_dedup(spark, folder):
    return Q.across_datasets(_documents(spark, folder), F.col("source"), "row_index").select("id", "source")


@query("ledger_additions", """WITH e AS (SELECT l_suppkey % 5 AS ledger_index, l_partkey AS id, l_orderkey AS stem FROM lineitem),
i AS (SELECT k AS ledger_index, count(*) AS new_ids FROM (SELECT id, min(ledger_index) AS k FROM e GROUP BY 1) GROUP BY 1),
s AS (SELECT k AS ledger_index, count(*) AS new_stems FROM (SELECT stem, min(ledger_index) AS k FROM e GROUP BY 1) GROUP BY 1)
SELECT ledger_index, coalesce(new_ids, 0) AS new_ids, coalesce(new_stems, 0) AS new_stems
FROM i FULL JOIN s USING (ledger_index)""")
def ledger_additions(spark, folder):
    entries = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("ledger_index"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("stem_key"))
    return Q.ledger_additions(entries)


@query("split_filter", """SELECT event_type, count(*) AS n FROM events
WHERE event_type = 'signup' OR value >= 20 GROUP BY 1""")
def split_filter(spark, folder):
    """Rows whose first named split is a test split, or that name none: sign-ups name no split here."""
    name = F.when(F.col("value") >= 20, " Internal-Test ").otherwise("train")
    kind = F.col("event_type")
    kept = table(spark, folder, "events").filter(Q.wanted_split(
        F.when(kind.isin("click", "error"), name), F.when(kind.isin("view", "purchase"), name),
        F.lit(None).cast("string")))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_KEY_SQL = """k AS (
  SELECT d.doc_id AS task_id, CASE WHEN d.doc_id % 3 = 0 THEN 'lexical_coverage' ELSE 'role' END AS task_kind,
         CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.lang END AS role, d.n_chars % 3 AS a, d.n_chars % 2 AS b,
         CASE WHEN d.doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS side,
         CASE WHEN l.toxic = 1 THEN 'cannot_tell' WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'A'
              WHEN d.doc_id % 5 = 0 THEN 'same' ELSE 'B' END AS rating
  FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, CASE rating WHEN 'A' THEN 1 WHEN 'B' THEN -1 WHEN 'same' THEN 0 END AS h, sign(a - b) AS m,
        CASE side WHEN 'A' THEN 1 ELSE -1 END AS s FROM k)"""


def decoded_ratings(spark, folder):
    documents = table(spark, folder, "documents")
    lexical = F.col("doc_id") % 3 == 0
    key = documents.select(
        F.col("doc_id").alias("task_id"), F.when(lexical, "lexical_coverage").otherwise("role").alias("task_kind"),
        F.when(~lexical, F.col("lang")).alias("role"), (F.col("n_chars") % 3).cast("double").alias("mechanical_a"),
        (F.col("n_chars") % 2).cast("double").alias("mechanical_b"),
        F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("treatment_response"))
    rating = F.when(F.col("toxic") == 1, "cannot_tell").when(F.col("quality") == 1, "A").when(
        F.col("doc_id") % 5 == 0, "same").otherwise("B")
    ratings = table(spark, folder, "labels").select(F.col("doc_id").alias("task_id"), rating.alias("rating"))
    return agreement.decode(key, ratings)


@query("agreement_sets", f"""WITH {_KEY_SQL}
SELECT task_kind, role, count(*) AS evaluable, round(avg((h = m)::INT), 6) AS raw_agreement,
       round(avg((h = m)::INT) FILTER (WHERE h <> 0 OR m <> 0), 6) AS non_tied_agreement,
       round(avg(s * (h - m)), 6) AS mean_correction, grouping(task_kind, role)::INT AS level
FROM r WHERE h IS NOT NULL GROUP BY GROUPING SETS ((), (task_kind), (task_kind, role))""")
def agreement_sets(spark, folder):
    found = agreement.agreement(decoded_ratings(spark, folder))
    return found.select("task_kind", "role", "evaluable", *[F.round(c, 6).alias(c) for c in (
        "raw_agreement", "non_tied_agreement", "mean_correction")], "level")


@query("discordant_pairs", f"""WITH {_KEY_SQL}
SELECT task_kind, count(*) FILTER (WHERE s * h > 0) AS wins, count(*) FILTER (WHERE s * h < 0) AS losses,
       count(*) FILTER (WHERE h = 0) AS ties FROM r WHERE h IS NOT NULL GROUP BY 1""")
def discordant_pairs(spark, folder):
    return agreement.discordant(decoded_ratings(spark, folder))


@query("correction_intervals")
def correction_intervals(spark, folder):
    """Question-clustered intervals of the signed correction by task kind."""
    from gridlens.operators.resample import clustered_bootstrap

    rated = decoded_ratings(spark, folder).filter("human_ab is not null").select(
        "task_kind", F.concat_ws("-", "role", (F.col("task_id") % 40)).alias("question_id"),
        F.col("correction").cast("double").alias("value"))
    return clustered_bootstrap(rated, ["task_kind"], seed=1730)


@query("confusion_matrix", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, folder):
    return agreement.confusion(table(spark, folder, "labels"), "quality", "toxic")


@query("confusion_summary", """SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement,
  round(avg(toxic) FILTER (WHERE quality = 1), 6) AS sensitivity,
  round(avg(1 - toxic) FILTER (WHERE quality <> 1), 6) AS specificity FROM labels""")
def confusion_summary(spark, folder):
    found = agreement.confusion_summary(table(spark, folder, "labels"), "quality", "toxic")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "sensitivity", "specificity")])


@query("identifier_scrub", """SELECT page_id, md5(regexp_replace(url, '(?i)https?://[^/?#]+', '<host>', 'g')) AS digest,
  regexp_matches(lower(html), 'track\\(') AS flagged FROM pages""")
def identifier_scrub(spark, folder):
    """Host names replaced before release, and pages that still hold a forbidden marker."""
    return table(spark, folder, "pages").select(
        "page_id", F.md5(F.regexp_replace("url", r"(?i)https?://[^/?#]+", "<host>")).alias("digest"),
        F.lower("html").rlike(r"track\(").alias("flagged"))


@query("stream_cell_state", ORACLES["cell_state_machine"])
def stream_cell_state(spark, folder):
    """The cell state machine fed by a stream of events."""
    from gridlens.operators import ledger
    from gridlens.plans.adapters import attempts_of

    table(spark, folder, "events")
    stream = state_events_of(attempts_of(E.read_events(spark, folder)))
    state = E.VersionedTable(spark, "cells")
    deciding = stream.filter("kind <> 'finished' or final_status is not null")
    last = E.fold_stream(deciding, state, E.fold_latest)
    cells = state_events(spark, folder).select("cell_id").distinct().select(
        "cell_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("content"))
    return ledger.fold_events(cells, last)


@query("stream_throughput", """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n,
  sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""")
def stream_throughput(spark, folder):
    table(spark, folder, "events")
    stream = E.read_events(spark, folder).select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    counted = E.throughput(stream, "ts", "event_type")
    state = E.VersionedTable(spark, "throughput")
    rows = E.fold_stream(counted, state, lambda before, batch: E.fold_rows(before, batch, ["start", "event_type"]),
                         mode="update")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")

