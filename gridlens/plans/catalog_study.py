"""Queries of the blinded study: changed roles, keys, rating sheets and the test of their confirmations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.functions.roles import ROLES
from gridlens.operators import sampling, study
from gridlens.operators.distributed import materialize
from gridlens.plans.adapters import ROLE_CELLS_SQL, role_cells, table
from gridlens.plans.registry import query

SEED = "study-v1"
_SCORES = [f"role_{r}" for r in ROLES]
_PAIRINGS = "\nUNION ALL\n".join(f"SELECT '{c}' AS control_condition, '{t}' AS treatment_condition" for c, t, _ in P.PAIRINGS)
_NAMES = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"


def _sha(*parts: str) -> str:
    return "sha256(" + " || chr(0) || ".join(parts) + ")"


_STUDY_SQL = f"""{ROLE_CELLS_SQL},
pairings AS ({_PAIRINGS}),
scored AS (
  SELECT c.question_id, c.model_id, c.dataset,
         substr({_sha(f"'{SEED}'", 'c.question_id', 'c.model_id', 'control_condition', 'treatment_condition')}, 1, 20) AS pair_id,
         [{', '.join(f'c.{s}' for s in _SCORES)}] AS c, [{', '.join(f't.{s}' for s in _SCORES)}] AS t,
         list_min([{', '.join(f'c.{s}' for s in _SCORES)}]) = 1 AS c8, list_min([{', '.join(f't.{s}' for s in _SCORES)}]) = 1 AS t8
  FROM pairings JOIN role_cells c ON c.condition_id = control_condition
  JOIN role_cells t ON t.condition_id = treatment_condition AND t.question_id = c.question_id AND t.model_id = c.model_id
  WHERE c.generation_usable AND t.generation_usable AND control_condition <> 'zero'),
strata AS (SELECT *, CASE WHEN t8 AND NOT c8 THEN 'improvement' WHEN c8 AND NOT t8 THEN 'degradation' ELSE 'tie' END AS stratum,
             list_filter(range(1, {len(ROLES) + 1}), lambda i: c[i] <> t[i]) AS moved,
             list_filter(range(1, {len(ROLES) + 1}), lambda i: c[i] = t[i]) AS still,
             ('0x' || substr({_sha(f"'{SEED}'", "'side'", 'pair_id')}, 64, 1))::INT % 2 AS parity FROM scored),
study AS (SELECT pair_id, question_id, model_id, dataset, stratum, list_transform(moved, lambda i: {_NAMES}[i]) AS changed_roles,
            CASE WHEN stratum = 'tie' THEN list_transform(list_sort(list_transform(still, lambda i:
                   {_sha(f"'{SEED}'", "'tie-role'", 'pair_id', f'{_NAMES}[i]')} || {_NAMES}[i]))[1:1], lambda h: substr(h, 65))
                 ELSE list_transform(moved, lambda i: {_NAMES}[i]) END AS shown_roles,
            CASE WHEN parity = 0 THEN 'A' ELSE 'B' END AS treatment_response,
            CASE stratum WHEN 'improvement' THEN CASE WHEN parity = 0 THEN 'A' ELSE 'B' END
              WHEN 'degradation' THEN CASE WHEN parity = 0 THEN 'B' ELSE 'A' END ELSE 'same' END AS preferred
          FROM strata),
answers AS (SELECT pair_id, ('0x' || substr({_sha("'rating'", 'pair_id')}, 1, 4))::INT % 12 AS draw FROM study),
rated AS (SELECT s.*, CASE WHEN draw < 6 THEN preferred WHEN draw < 8 THEN 'same' WHEN draw < 9 THEN 'cannot_tell'
            WHEN draw < 11 THEN CASE preferred WHEN 'A' THEN 'B' ELSE 'A' END END AS rating FROM study s JOIN answers USING (pair_id)),
decoded AS (SELECT *, CASE WHEN rating IS NOT NULL THEN rating <> 'cannot_tell' AND rating = preferred END AS confirmed,
              coalesce(preferred <> 'same' AND rating IN ('A', 'B') AND rating <> preferred, false) AS opposite FROM rated)"""


def key(spark, folder):
    pairs = sampling.matched_pairs(role_cells(spark, folder), SEED, [*_SCORES, "generation_usable"])
    scores = [F.col(f"{side}_role_{r}").alias(f"{side}_{r}") for side in ("control", "treatment") for r in ROLES]
    written = F.col("control_generation_usable") & F.col("treatment_generation_usable")
    return study.study_key(pairs.select("pair_id", "question_id", "model_id", "dataset", written.alias("written"), *scores),
                           ROLES, SEED, written=F.col("written"))


def decoded(spark, folder):
    """Rated pairs; a rating follows the scores, or not, by a hash of its pair, and one in twelve is missing."""
    pairs = materialize(key(spark, folder))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit("rating\0"), F.col("pair_id")), 256), 1, 4), 16, 10).cast("int") % 12
    rating = F.when(draw < 6, F.col("preferred")).when(draw < 8, "same").when(draw < 9, "cannot_tell").when(
        draw < 11, F.when(F.col("preferred") == "A", "B").otherwise("A"))
    return study.confirmations(pairs, pairs.select("pair_id", rating.alias("rating")))


@query("role_differences", f"""WITH {_STUDY_SQL}
SELECT pair_id, stratum, array_to_string(changed_roles, '+') AS changed_roles, array_to_string(shown_roles, '+') AS shown_roles,
       treatment_response, preferred FROM study""")
def role_differences(spark, folder):
    """Roles that tell both responses of a pair apart, and those a rater is shown."""
    return key(spark, folder).select("pair_id", "stratum", F.array_join("changed_roles", "+").alias("changed_roles"),
                                     F.array_join("shown_roles", "+").alias("shown_roles"), "treatment_response", "preferred")


@query("rating_sentinels", f"""WITH {_STUDY_SQL}
SELECT stratum, treatment_response, count(*) AS n, count(*) FILTER (WHERE confirmed) AS confirmed,
  {', '.join(f"count(*) FILTER (WHERE rating = '{r}') AS human_{r}" for r in study.RATINGS)} FROM decoded GROUP BY 1, 2""")
def rating_sentinels(spark, folder):
    """Answers by stratum and by the side that showed the treatment."""
    return study.sentinels(decoded(spark, folder), ["stratum", "treatment_response"])


@query("rating_patterns", f"""WITH {_STUDY_SQL}
SELECT array_to_string(changed_roles, '+') AS pattern, count(*) AS n, count(*) FILTER (WHERE confirmed) AS confirmed,
  {', '.join(f"count(*) FILTER (WHERE rating = '{r}') AS human_{r}" for r in study.RATINGS)}
FROM decoded WHERE stratum = 'improvement' GROUP BY 1""")
def rating_patterns(spark, folder):
    """Confirmed improvements by the combination of roles that changed."""
    primary = decoded(spark, folder).filter("stratum = 'improvement'")
    return study.sentinels(primary.withColumn("pattern", F.array_join("changed_roles", "+")), ["pattern"])


_LOG_CHOOSE = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"


@query("confirm_test", f"""WITH RECURSIVE {_STUDY_SQL},
counted AS (SELECT dataset, grouping(dataset)::INT AS level, count(*) AS n, count(*) FILTER (WHERE confirmed) AS confirmations,
    count(*) FILTER (WHERE rating = 'same') AS same, count(*) FILTER (WHERE rating = 'cannot_tell') AS cannot_tell,
    count(*) FILTER (WHERE opposite) AS opposite
  FROM decoded WHERE stratum = 'improvement' AND confirmed IS NOT NULL GROUP BY GROUPING SETS ((), (dataset))),
terms AS (SELECT level, dataset, n, confirmations, i, {_LOG_CHOOSE} AS c FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM counted)),
tails AS (SELECT level, dataset, i, sum(exp(c + n * ln(0.5))) OVER (PARTITION BY level, dataset ORDER BY i DESC) AS tail FROM terms),
critical AS (SELECT level, dataset, min(i) AS critical FROM tails WHERE tail <= 0.05 GROUP BY ALL),
bounds AS (
  SELECT 0 AS step, level, dataset, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM counted
  UNION ALL
  SELECT step + 1, level, dataset, CASE WHEN tail < 0.05 THEN m ELSE low END, CASE WHEN tail < 0.05 THEN high ELSE m END
  FROM (SELECT b.step, b.level, b.dataset, b.low, b.high, (b.low + b.high) / 2 AS m, sum(exp(t.c + t.i * ln((b.low + b.high) / 2)
          + (t.n - t.i) * ln(1 - (b.low + b.high) / 2))) AS tail
        FROM bounds b JOIN terms t ON t.level = b.level AND t.dataset IS NOT DISTINCT FROM b.dataset AND t.i >= t.confirmations
        WHERE b.step < 40 GROUP BY ALL))
SELECT k.dataset, k.level, n, confirmations, same, cannot_tell, opposite, round(confirmations / n, 6) AS rate,
       round(tail, 6) AS p_value, round(low, 6) AS lower_bound, critical, confirmations >= critical AS rejected
FROM counted k JOIN critical c ON c.level = k.level AND c.dataset IS NOT DISTINCT FROM k.dataset
JOIN tails t ON t.level = k.level AND t.dataset IS NOT DISTINCT FROM k.dataset AND t.i = confirmations
JOIN bounds b ON b.level = k.level AND b.dataset IS NOT DISTINCT FROM k.dataset AND b.step = 40""")
def confirm_test(spark, folder):
    """Exact test of the confirmed improvements, over all and by dataset."""
    tested = study.confirm_test(decoded(spark, folder).filter("stratum = 'improvement'"), ["dataset"])
    return tested.select("dataset", "level", "n", "confirmations", "same", "cannot_tell", "opposite", "critical", "rejected",
                         *[F.round(c, 6).alias(c) for c in ("rate", "p_value", "lower_bound")])


_SHEETS_SQL = """sheets AS (
  SELECT event_id // 10 AS sheet_id, CASE WHEN event_id // 10 % 11 = 0 THEN 'study-v0' ELSE 'study-v1' END AS version,
         CASE WHEN event_id // 10 % 13 = 0 THEN NULL ELSE 'audit' END AS audit_id,
         CASE WHEN event_id // 10 % 7 = 0 THEN ' ' ELSE 'R' || (event_id // 10 % 3)::VARCHAR END AS reviewer,
         CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id % 10 END::VARCHAR AS task_id, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B'
           WHEN 'purchase' THEN 'same' WHEN 'signup' THEN 'cannot_tell' ELSE CASE WHEN event_id % 3 = 0 THEN '' ELSE 'A' END END AS rating
  FROM events WHERE event_id % 131 <> 0),
by_task AS (SELECT sheet_id, task_id, count(*) AS n FROM sheets GROUP BY 1, 2),
sizes AS (SELECT sheet_id, count(*) AS n FROM sheets GROUP BY 1),
violations AS (
  SELECT DISTINCT sheet_id, NULL::VARCHAR AS task_id, 'version_known' AS rule FROM sheets WHERE version <> 'study-v1'
  UNION ALL SELECT DISTINCT sheet_id, NULL, 'audit_matches' FROM sheets WHERE audit_id IS NULL
  UNION ALL SELECT DISTINCT sheet_id, NULL, 'reviewer_named' FROM sheets WHERE trim(reviewer) = ''
  UNION ALL SELECT sheet_id, NULL, 'all_tasks_rated' FROM sizes WHERE n <> {tasks}
  UNION ALL SELECT sheet_id, task_id, 'task_rated_once' FROM by_task WHERE n > 1
  UNION ALL SELECT DISTINCT sheet_id, task_id, 'rating_allowed' FROM sheets WHERE rating = '')"""
_TASKS = 10


def sheets(spark, folder):
    """Rating sheets from events: ten events in a row are the answers on one sheet, a few tasks repeat or are missing."""
    event = F.col("event_id")
    sheet = F.expr("event_id div 10")
    kinds = F.create_map(*[F.lit(x) for x in ("view", "A", "click", "B", "purchase", "same", "signup", "cannot_tell")])
    rating = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.when(event % 3 == 0, "").otherwise("A"))
    return table(spark, folder, "events").filter("event_id % 131 <> 0").select(
        sheet.alias("sheet_id"), F.when(sheet % 11 == 0, "study-v0").otherwise("study-v1").alias("version"),
        F.when(sheet % 13 != 0, "audit").alias("audit_id"),
        F.when(sheet % 7 == 0, " ").otherwise(F.concat(F.lit("R"), (sheet % 3).cast("string"))).alias("reviewer"),
        F.when(event % 97 == 0, "0").otherwise((event % 10).cast("string")).alias("task_id"), rating.alias("rating"))


@query("rating_violations", f"WITH {_SHEETS_SQL.format(tasks=_TASKS)} SELECT * FROM violations")
def rating_violations(spark, folder):
    return study.sheet_violations(sheets(spark, folder), version="study-v1", audit="audit", tasks=_TASKS)


@query("frozen_ratings", f"""WITH {_SHEETS_SQL.format(tasks=_TASKS)}
SELECT sheet_id, max(reviewer) AS reviewer, count(*) AS n,
       sha256(array_to_string(list_sort(list(task_id || chr(9) || rating)), chr(10))) AS digest
FROM sheets WHERE sheet_id NOT IN (SELECT sheet_id FROM violations) GROUP BY 1""")
def frozen_ratings(spark, folder):
    """Sheets that can be frozen, with the digest that pins their answers."""
    return study.frozen_sheets(sheets(spark, folder), version="study-v1", audit="audit", tasks=_TASKS)


@query("hint_lines", """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\\b(?:answer|question|change)')) AS f
  FROM documents)
SELECT doc_id, len(f[1:4]) AS n, md5(array_to_string(list_transform(f[1:4], lambda x: substr(trim(x), 1, 240)), chr(10))) AS digest
FROM l""")
def hint_lines(spark, folder):
    """First lines of a text that hint at a changed answer."""
    found = table(spark, folder, "documents").select(
        "doc_id", study.hint_lines(F.col("text"), r"(?i)\b(?:answer|question|change)").alias("lines"))
    return found.select("doc_id", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("flag_histogram", """WITH f AS (SELECT concat_ws('|', CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END,
  CASE WHEN NOT contains(text, '.') THEN 'no_sentence' END, CASE WHEN contains(text, '@') THEN 'address' END) AS flags FROM documents)
SELECT flags, count(*) AS n, flags = '' AS eligible FROM f GROUP BY 1""")
def flag_histogram(spark, folder):
    """Combinations of review flags over all documents."""
    text = F.col("text")
    flags = F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("lang") != "en", "language"),
                    F.when(~text.contains("."), "no_sentence"), F.when(text.contains("@"), "address"))
    return study.flag_histogram(table(spark, folder, "documents"), flags)
