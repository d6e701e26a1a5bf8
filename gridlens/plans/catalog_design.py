"""Queries that plan, validate and sample the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.functions.keys import hash_key
from gridlens.functions.roles import ROLES
from gridlens.operators import grid, sampling
from gridlens.plans.adapters import CELLS_SQL, ROLE_CELLS_SQL, dealt, grid_cells, role_cells, table, tasks_for
from gridlens.plans.registry import query

MODELS = tuple(f"m{i}" for i in range(7))
AUDIT = "audit-v1"

_PLAN_SQL = f"""q AS (SELECT p_partkey::VARCHAR AS question_id FROM part),
m AS (SELECT 'm' || unnest(range(7)) AS model_id),
c AS (SELECT unnest([{', '.join(f"'{c}'" for c in P.CONDITION_IDS)}]) AS condition_id),
plan AS (SELECT *, sha256('cell-v2' || chr(0) || question_id || chr(0) || model_id || chr(0) || condition_id) AS cell_id
         FROM q, m, c),
keyed AS (SELECT *, sha256('sha256-balanced-cell-order-v1' || chr(0) || cell_id) AS schedule_key FROM plan)"""


def planned(spark, folder):
    parts = table(spark, folder, "part")
    questions = parts.select(F.col("p_partkey").cast("string").alias("question_id"))
    return grid.expand(questions.repartition(tasks_for(parts, 256), "question_id"), MODELS)


@query("plan_grid", f"WITH {_PLAN_SQL} SELECT question_id, model_id, condition_id, cell_id, schedule_key FROM keyed")
def plan_grid(spark, folder):
    return planned(spark, folder)


@query("schedule_order", f"""WITH {_PLAN_SQL}
SELECT cell_id, row_number() OVER (ORDER BY schedule_key, cell_id) - 1 AS schedule_index FROM keyed""")
def schedule_order(spark, folder):
    return grid.schedule(planned(spark, folder).drop("cell_id", "schedule_key")).select("cell_id", "schedule_index")


@query("plan_counts", f"""WITH {_PLAN_SQL} SELECT count(*) AS cells, count(DISTINCT question_id) AS questions,
count(DISTINCT model_id) AS models FROM keyed""")
def plan_counts(spark, folder):
    return grid.plan_counts(planned(spark, folder))


@query("first_appearance", """SELECT event_type, min(event_id) AS first_seen, count(*) AS n FROM events GROUP BY 1""")
def first_appearance(spark, folder):
    return grid.first_appearance(table(spark, folder, "events"), "event_type", "event_id")


@query("representative_cell", """SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'en'
ORDER BY length(text) DESC, doc_id LIMIT 1""")
def representative_cell(spark, folder):
    documents = table(spark, folder, "documents").filter("lang = 'en'")
    top = grid.largest_by(documents, F.length("text"), "doc_id")
    return top.select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("pending_cells", f"""WITH {_PLAN_SQL},
s AS (SELECT *, CASE p_size % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'retryable' ELSE 'failed' END
        AS status FROM keyed JOIN part ON p_partkey::VARCHAR = question_id)
SELECT cell_id, p_name AS stem, status FROM s WHERE status IN ('pending', 'retryable') AND model_id IN ('m0', 'm3')""")
def pending_cells(spark, folder):
    from gridlens.operators.ledger import pending

    parts = dealt(spark, folder, "part", "p_partkey").select(
        F.col("p_partkey").cast("string").alias("question_id"), F.col("p_name").alias("stem"),
        F.element_at(F.array(*[F.lit(s) for s in ("completed", "pending", "retryable", "failed")]),
                     F.col("p_size") % 4 + 1).alias("status"))
    cells = grid.expand(parts, MODELS, keep=["status"])
    return pending(cells, parts.select("question_id", "stem"), ["m0", "m3"]).select("cell_id", "stem", "status")


@query("constraint_violations", """
SELECT c_custkey AS row_id, 'balance_not_negative' AS rule FROM customer WHERE NOT c_acctbal >= 0
UNION ALL SELECT c_custkey, 'segment_known' FROM customer WHERE NOT c_mktsegment IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT c_custkey, 'name_present' FROM customer WHERE NOT trim(c_name) <> ''""")
def constraint_violations(spark, folder):
    return grid.violations(table(spark, folder, "customer"), "c_custkey", {
        "balance_not_negative": F.col("c_acctbal") >= 0,
        "segment_known": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
        "name_present": F.trim("c_name") != "",
    })


@query("cell_integrity", f"""WITH {CELLS_SQL},
k AS (SELECT question_id || '/' || model_id || '/' || condition_id AS cell, * FROM cells)
SELECT cell AS row_id, 'completed_has_content' AS rule FROM k WHERE status = 'completed' AND output_tokens % 3 = 0
UNION ALL SELECT cell, 'failure_has_error' FROM k WHERE status = 'truncated'""")
def cell_integrity(spark, folder):
    cells = grid_cells(spark, folder).select(
        F.concat_ws("/", "question_id", "model_id", "condition_id").alias("cell"), "question_id", "model_id",
        "condition_id", "status", P.copies(F.col("condition_id")).alias("copies"),
        F.when(F.col("output_tokens") % 3 != 0, "text").alias("content"),
        F.when(F.col("status") == "failed", "provider error").alias("error"),
        F.lit(None).cast("bigint").alias("input_tokens"), "output_tokens")
    return grid.violations(cells, "cell", grid.cell_rules())


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2
HAVING count(*) > 1""")
def duplicate_keys(spark, folder):
    return grid.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("fk_orphans", """SELECT o_orderkey FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def fk_orphans(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return grid.orphans(orders, table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey")


@query("key_differences", """SELECT k AS doc_id, 'left' AS side FROM (SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT k, 'right' FROM (SELECT doc_id AS k FROM labels EXCEPT SELECT doc_id FROM documents)""")
def key_differences(spark, folder):
    """Documents without a label, and labels without a document."""
    left, right = (table(spark, folder, name).select("doc_id") for name in ("documents", "labels"))
    return grid.key_differences(left, right, "doc_id")


_PAIR_ROWS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS control_condition, '{t}' AS treatment_condition, 'add_{a}_copy' AS added_copy"
    for c, t, a in P.PAIRINGS)
_PAIRS_SQL = f"""{CELLS_SQL},
pairings AS ({_PAIR_ROWS}),
pairs AS (
  SELECT c.question_id, c.model_id, c.dataset, control_condition, treatment_condition, added_copy,
         c.recall AS control_recall, t.recall AS treatment_recall,
         substr(sha256('{AUDIT}' || chr(0) || c.question_id || chr(0) || c.model_id || chr(0) || control_condition
                || chr(0) || treatment_condition), 1, 20) AS pair_id
  FROM pairings JOIN cells c ON c.condition_id = control_condition
  JOIN cells t ON t.condition_id = treatment_condition AND t.question_id = c.question_id AND t.model_id = c.model_id),
judged AS (SELECT *, CASE WHEN treatment_recall > control_recall THEN 'improvement'
                          WHEN treatment_recall < control_recall THEN 'degradation' ELSE 'tie' END AS stratum
           FROM pairs WHERE control_recall IS NOT NULL AND treatment_recall IS NOT NULL)"""


def pairs(spark, folder):
    return sampling.matched_pairs(grid_cells(spark, folder), AUDIT, ["recall"])


def judged_pairs(spark, folder):
    eligible = pairs(spark, folder).filter("control_recall is not null and treatment_recall is not null")
    return eligible.withColumn("stratum", sampling.change_stratum(F.col("control_recall"), F.col("treatment_recall")))


@query("matched_pairs", f"""WITH {_PAIRS_SQL}
SELECT question_id, model_id, dataset, control_condition, treatment_condition, added_copy, pair_id,
       round(control_recall, 6) AS control_recall, round(treatment_recall, 6) AS treatment_recall FROM pairs""")
def matched_pairs(spark, folder):
    return pairs(spark, folder).select(
        "question_id", "model_id", "dataset", "control_condition", "treatment_condition", "added_copy", "pair_id",
        F.round("control_recall", 6).alias("control_recall"), F.round("treatment_recall", 6).alias("treatment_recall"))


@query("pair_strata", f"""WITH {_PAIRS_SQL}
SELECT control_condition, treatment_condition, stratum, count(*) AS n FROM judged GROUP BY ALL""")
def pair_strata(spark, folder):
    return judged_pairs(spark, folder).groupBy("control_condition", "treatment_condition", "stratum").agg(
        F.count(F.lit(1)).alias("n"))


@query("side_assignment", f"""WITH {_PAIRS_SQL}
SELECT pair_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY
    sha256('seed' || chr(0) || 'orientation' || chr(0) || stratum || chr(0) || pair_id))
  <= count(*) OVER (PARTITION BY stratum) // 2 THEN 'A' ELSE 'B' END AS side FROM judged""")
def side_assignment(spark, folder):
    items = judged_pairs(spark, folder).select("pair_id", "stratum")
    return sampling.assign_sides(items, "stratum", hash_key("seed", "orientation", F.col("stratum"), F.col("pair_id")))


@query("blind_pairs", f"""WITH {_PAIRS_SQL},
h AS (SELECT *, ('0x' || substr(sha256('{AUDIT}' || chr(0) || pair_id), 64, 1))::INT % 2 AS parity FROM judged)
SELECT pair_id, round(CASE WHEN parity = 0 THEN treatment_recall ELSE control_recall END, 6) AS response_a,
       round(CASE WHEN parity = 0 THEN control_recall ELSE treatment_recall END, 6) AS response_b,
       CASE WHEN parity = 0 THEN 'A' ELSE 'B' END AS treatment_response FROM h""")
def blind_pairs(spark, folder):
    blind = sampling.blind_sides(judged_pairs(spark, folder), AUDIT, "control_recall", "treatment_recall")
    return blind.select("pair_id", F.round("response_a", 6).alias("response_a"),
                        F.round("response_b", 6).alias("response_b"), "treatment_response")


@query("hash_sample_topn", f"""WITH {_PAIRS_SQL}
SELECT pair_id, stratum FROM judged WHERE stratum = 'improvement'
ORDER BY sha256('seed' || chr(0) || 'sample' || chr(0) || 'primary' || chr(0) || pair_id) LIMIT 30""")
def hash_sample_topn(spark, folder):
    pool = judged_pairs(spark, folder).filter("stratum = 'improvement'").select("pair_id", "stratum")
    return sampling.hash_sample(pool, 30, "seed", "primary", "pair_id")


@query("one_per_question", f"""WITH {_PAIRS_SQL},
p AS (SELECT question_id, arg_min(pair_id, sha256('{AUDIT}' || chr(0) || pair_id || chr(0) || 'lexical')) AS pair_id
      FROM judged GROUP BY 1)
SELECT question_id, pair_id FROM p
ORDER BY sha256('{AUDIT}' || chr(0) || question_id || chr(0) || 'lexical' || chr(0) || 'question') LIMIT 20""")
def one_per_question(spark, folder):
    return sampling.one_per_question(judged_pairs(spark, folder), 20, AUDIT, "lexical").select("question_id", "pair_id")


_QUOTA_SQL = """counts AS (SELECT o_orderpriority AS pattern, count(*) AS count FROM orders GROUP BY 1),
exact AS (SELECT *, 97.0::DOUBLE * count / sum(count) OVER () AS e FROM counts),
based AS (SELECT *, floor(e) AS b FROM exact),
ranked AS (SELECT *, row_number() OVER (ORDER BY e - b DESC, count DESC, sha256('seed' || chr(0) || pattern), pattern) AS k,
             97 - sum(b) OVER () AS remaining FROM based),
quotas AS (SELECT pattern, count, (b + CASE WHEN k <= remaining THEN 1 ELSE 0 END)::BIGINT AS quota FROM ranked)"""


def quotas(spark, folder):
    counts = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("pattern")).count()
    return sampling.proportional_quota(counts, 97, "pattern", hash_key("seed", F.col("pattern")))


@query("quota_allocation", f"WITH {_QUOTA_SQL} SELECT pattern, count, quota FROM quotas")
def quota_allocation(spark, folder):
    return quotas(spark, folder)


@query("quota_sample", f"""WITH {_QUOTA_SQL}
SELECT o_orderkey, o_orderpriority AS pattern FROM orders JOIN quotas ON pattern = o_orderpriority
QUALIFY row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY sha256('seed' || chr(0) || o_orderkey::VARCHAR)) <= quota""")
def quota_sample(spark, folder):
    pool = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pattern"))
    order = hash_key("seed", F.col("o_orderkey").cast("string"))
    return sampling.quota_sample(pool, quotas(spark, folder), "pattern", order, 97)


@query("fair_dequeue", """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn
FROM events""")
def fair_dequeue(spark, folder):
    return sampling.fair_dequeue(table(spark, folder, "events").select("event_id", "event_type"), "event_type", "event_id")


_ROOMS_SQL = """counts AS (SELECT c_nationkey AS pattern, count(*) AS count,
    count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS room FROM customer GROUP BY 1),
n AS (SELECT sum(room)::BIGINT * 9 // 10 AS n FROM counts),
exact AS (SELECT *, n::DOUBLE * count / sum(count) OVER () AS e FROM counts, n),
ranked AS (SELECT *, floor(e) AS b, row_number() OVER (ORDER BY e - floor(e) DESC, count DESC,
             sha256('seed' || chr(0) || pattern::VARCHAR), pattern) AS k, n - sum(floor(e)) OVER () AS remaining FROM exact),
wanted AS (SELECT pattern, count, room, (b + CASE WHEN k <= remaining THEN 1 ELSE 0 END)::BIGINT AS w FROM ranked),
slots AS (SELECT pattern, unnest(range(1, room - w + 1)) AS left_over FROM wanted WHERE room > w),
extra AS (SELECT pattern FROM slots ORDER BY left_over DESC, sha256('spare' || chr(0) || pattern::VARCHAR)
          LIMIT (SELECT sum(greatest(w - room, 0)) FROM wanted)),
given AS (SELECT pattern, count(*) AS g FROM extra GROUP BY 1)"""


@query("quota_overflow", f"""WITH {_ROOMS_SQL}
SELECT pattern, count, room, (least(w, room) + coalesce(g, 0))::BIGINT AS quota FROM wanted LEFT JOIN given USING (pattern)""")
def quota_overflow(spark, folder):
    """Draws in proportion to a nation's customers, from one segment only: what a nation lacks goes to the roomiest ones."""
    counts = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("pattern")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("room"))
    name = F.col("pattern").cast("string")
    return sampling.proportional_quota(counts, F.expr("sum(room) over (partition by true) * 9 div 10"), "pattern",
                                       hash_key("seed", name), capacity="room", spare_tie=hash_key("spare", name))


_PICK = ("model_id", "dataset", "condition_id")


@query("balanced_pick", f"""WITH RECURSIVE {ROLE_CELLS_SQL},
named AS (SELECT concat_ws('/', question_id, model_id, condition_id) AS cell_id, question_id, model_id, dataset, condition_id,
            output_tokens % 4 = 0 AS hinted FROM role_cells WHERE status = 'completed' AND condition_id <> 'zero'),
pool AS (SELECT *, sha256('seed' || chr(0) || cell_id) AS h FROM named),
walk AS (
  SELECT 0 AS pick, ''::VARCHAR AS cell_id, ''::VARCHAR AS question_id, ''::VARCHAR AS model_id, ''::VARCHAR AS dataset,
         ''::VARCHAR AS condition_id, false AS hinted, []::VARCHAR[] AS questions, []::VARCHAR[] AS models,
         []::VARCHAR[] AS datasets, []::VARCHAR[] AS conditions
  UNION ALL
  SELECT s.* FROM (SELECT w.pick + 1 AS pick, c.cell_id, c.question_id, c.model_id, c.dataset, c.condition_id, c.hinted,
      list_append(w.questions, c.question_id) AS questions, list_append(w.models, c.model_id) AS models,
      list_append(w.datasets, c.dataset) AS datasets, list_append(w.conditions, c.condition_id) AS conditions
    FROM walk w, pool c WHERE w.pick < 60 AND NOT list_contains(w.questions, c.question_id)
    ORDER BY len(list_filter(w.models, lambda x: x = c.model_id)), len(list_filter(w.datasets, lambda x: x = c.dataset)),
             len(list_filter(w.conditions, lambda x: x = c.condition_id)), (NOT c.hinted)::INT, c.h LIMIT 1) s)
SELECT pick, cell_id, question_id, model_id, dataset, condition_id, hinted FROM walk WHERE pick > 0""")
def balanced_pick(spark, folder):
    """Sixty completed cells from different questions, even over models, datasets and conditions."""
    cells = role_cells(spark, folder).filter("status = 'completed' and condition_id <> 'zero'").select(
        F.concat_ws("/", "question_id", "model_id", "condition_id").alias("cell_id"), "question_id", *_PICK,
        (F.col("output_tokens") % 4 == 0).alias("hinted"))
    return sampling.balanced_pick(cells, 60, "seed")


_SCORES = [f"role_{r}" for r in ROLES]
_ROLE_PAIRS_SQL = f"""{ROLE_CELLS_SQL},
pairings AS ({_PAIR_ROWS}),
role_pairs AS (
  SELECT c.question_id, c.model_id, control_condition, treatment_condition,
         substr(sha256('{AUDIT}' || chr(0) || c.question_id || chr(0) || c.model_id || chr(0) || control_condition
                || chr(0) || treatment_condition), 1, 20) AS pair_id,
         coalesce(t.recall <> c.recall, false) AS lexical,
         [{', '.join(f'c.{s}' for s in _SCORES)}] AS control, [{', '.join(f't.{s}' for s in _SCORES)}] AS treatment
  FROM pairings JOIN role_cells c ON c.condition_id = control_condition
  JOIN role_cells t ON t.condition_id = treatment_condition AND t.question_id = c.question_id AND t.model_id = c.model_id),
flagged AS (SELECT *, list_transform(range({len(ROLES)}), lambda i: coalesce(control[i + 1] <> treatment[i + 1], false)) AS flags
            FROM role_pairs)"""


def role_pairs(spark, folder):
    return sampling.matched_pairs(role_cells(spark, folder), AUDIT, ["recall", *_SCORES])


def _fill_sql() -> str:
    """One step per role: its unused pairs in hash order, as many as it lacks."""
    steps = []
    for k, role in enumerate(ROLES):
        used = " UNION ALL ".join(["SELECT pair_id FROM chosen"] + [f"SELECT pair_id FROM fill{i}" for i in range(k)])
        steps.append(f"""fill{k} AS MATERIALIZED (SELECT {k} AS role, pair_id, question_id FROM flagged
  WHERE flags[{k + 1}] AND question_id IN (SELECT question_id FROM chosen) AND pair_id NOT IN ({used})
  QUALIFY row_number() OVER (ORDER BY sha256('{AUDIT}' || chr(0) || pair_id || chr(0) || 'role-fill:{role}'))
    <= 15 - (SELECT count(*) FROM deal WHERE role = {k}))""")
    return ",\n".join(steps)


def _per_question_sql(source: str, salt: str, n: int) -> str:
    return f"""SELECT question_id, pair_id, row_number() OVER (ORDER BY h) AS place FROM (
  SELECT question_id, arg_min(pair_id, sha256('{AUDIT}' || chr(0) || pair_id || chr(0) || '{salt}')) AS pair_id,
         sha256('{AUDIT}' || chr(0) || question_id || chr(0) || '{salt}' || chr(0) || 'question') AS h
  FROM {source} GROUP BY question_id) QUALIFY place <= {n}"""


_AUDIT_SQL = f"""WITH RECURSIVE {_ROLE_PAIRS_SQL},
lexical AS MATERIALIZED ({_per_question_sql("flagged WHERE lexical", "lexical", 79)}),
free AS (SELECT * FROM flagged WHERE list_contains(flags, true) AND question_id NOT IN (SELECT question_id FROM lexical)),
extra AS MATERIALIZED ({_per_question_sql("free", "role-question-coverage", 69)}),
turns AS (SELECT place, pair_id, question_id, flags FROM extra JOIN flagged USING (pair_id, question_id)),
deal AS (
  SELECT 0::BIGINT AS place, 0::BIGINT AS cursor, list_transform(range({len(ROLES)}), lambda i: 0::BIGINT) AS counts,
         NULL::BIGINT AS role, NULL::VARCHAR AS pair_id, NULL::VARCHAR AS question_id
  UNION ALL
  SELECT place, (r + 1) % {len(ROLES)}, list_transform(counts, lambda c, i: c + (i - 1 = r)::BIGINT), r, pair_id, question_id
  FROM (SELECT t.place, d.counts, t.pair_id, t.question_id, list_filter(
          list_transform(range({len(ROLES)}), lambda o: (d.cursor + o) % {len(ROLES)}),
          lambda x: t.flags[x + 1] AND d.counts[x + 1] < 15)[1] AS r
        FROM deal d JOIN turns t ON t.place = d.place + 1)),
chosen AS MATERIALIZED (SELECT question_id, pair_id FROM lexical UNION ALL SELECT question_id, pair_id FROM extra),
{_fill_sql()},
tasks AS (SELECT 'lexical' AS task, NULL::VARCHAR AS role, pair_id, question_id FROM lexical
  UNION ALL SELECT 'role', [{', '.join(f"'{r}'" for r in ROLES)}][role + 1], pair_id, question_id FROM (
    SELECT role, pair_id, question_id FROM deal WHERE role IS NOT NULL
    {' '.join(f'UNION ALL SELECT * FROM fill{k}' for k in range(len(ROLES)))}))
SELECT *, CASE WHEN ('0x' || substr(sha256('{AUDIT}' || chr(0) || pair_id || chr(0) || coalesce(role, 'lexical') || chr(0)
         || 'side'), 64, 1))::INT % 2 = 0 THEN 'A' ELSE 'B' END AS treatment_response,
       row_number() OVER (ORDER BY sha256('{AUDIT}' || chr(0) || pair_id || chr(0) || coalesce(role, 'lexical') || chr(0)
         || 'display')) AS display_order FROM tasks"""


@query("audit_tasks", _AUDIT_SQL)
def audit_tasks(spark, folder):
    """The blinded audit over all pairs: 79 lexical tasks, 148 questions, 15 tasks for each of the eight roles."""
    found = role_pairs(spark, folder)
    differs = [(F.col(f"control_{s}") != F.col(f"treatment_{s}")).alias(r) for s, r in zip(_SCORES, ROLES)]
    lexical = (F.col("control_recall") != F.col("treatment_recall")).alias("lexical_eligible")
    return sampling.audit_tasks(found.select("pair_id", "question_id", lexical, *differs), AUDIT, ROLES)


@query("provider_order", """SELECT n_regionkey AS region, list_concat(
  list_filter(['NATION 7', 'NATION 3', 'NATION 12'], lambda p: list_contains(list_transform(names, lambda n: upper(n)), p)),
  list_sort(list_filter(list_transform(names, lambda n: upper(n)), lambda n: n NOT IN ('NATION 7', 'NATION 3', 'NATION 12'))))
  AS names FROM (SELECT n_regionkey, list(n_name) AS names FROM nation GROUP BY 1)""")
def provider_order(spark, folder):
    """Nations as providers of their region: preferred ones first, the rest alphabetically."""
    regions = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(
        F.collect_list("n_name").alias("names"))
    preferred = F.array(F.lit("nation 7"), F.lit("Nation 3"), F.lit("NATION 12"))
    ordered = sampling.preference_order(F.col("names"), preferred)
    return regions.select("region", F.transform(ordered, lambda n: F.upper(n)).alias("names"))


@query("ceiling_violations", """SELECT s_suppkey AS row_id, rule FROM (
  SELECT s_suppkey, s_suppkey % 9 * 128 AS c, s_suppkey % 700 AS o, 768 AS k FROM supplier), (
  SELECT unnest(['ceiling_has_headroom', 'ceiling_is_multiple_of_256', 'ceiling_within_capability']) AS rule)
WHERE (rule = 'ceiling_has_headroom' AND c < o * 1.25) OR (rule = 'ceiling_is_multiple_of_256' AND c % 256 <> 0)
  OR (rule = 'ceiling_within_capability' AND c > k)""")
def ceiling_violations(spark, folder):
    from gridlens.operators.ledger import ceiling_rules

    models = table(spark, folder, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 9 * 128).alias("output_ceiling"),
        (F.col("s_suppkey") % 700).alias("observed_max"), F.lit(768).alias("capability"))
    return grid.violations(models, "s_suppkey", ceiling_rules())


@query("route_bottlenecks", """SELECT s_suppkey AS model_id, round(least(c, u) / u, 6) AS ratio, cooldown FROM (
  SELECT s_suppkey, least(s_suppkey % 13 + 1, 8) AS u, s_suppkey % 5 + 1 AS c, s_suppkey % 3 AS active,
         s_nationkey % 4 AS cooldown FROM supplier)
WHERE (least(c, u) < u AND active >= least(c, u)) OR cooldown > 0""")
def route_bottlenecks(spark, folder):
    from gridlens.operators.ledger import bottlenecks

    key = F.col("s_suppkey")
    routes = table(spark, folder, "supplier").select(
        key.alias("model_id"), (key % 13 + 1).alias("route_concurrency"), F.lit(8).alias("model_concurrency"),
        (key % 5 + 1).alias("current_limit"), (key % 3).alias("active"), (F.col("s_nationkey") % 4).alias("cooldown"))
    return bottlenecks(routes).select("model_id", F.round("ratio", 6).alias("ratio"), "cooldown")
