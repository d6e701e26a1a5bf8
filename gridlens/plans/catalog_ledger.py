"""Queries over the attempt ledger and cell state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import billing, keys
from gridlens.operators import ledger
from gridlens.plans.adapters import ATTEMPTS_SQL, attempts, table
from gridlens.plans.registry import ORACLES, query


@query("spend_total", f"""WITH {ATTEMPTS_SQL}
SELECT round(sum(accounted_cost_usd), 2) AS spend, count(accounted_cost_usd) AS charged FROM attempts""")
def spend_total(spark, folder):
    total = ledger.spend(attempts(spark, folder), "accounted_cost_usd")
    return total.select(F.round("spend", 2).alias("spend"), "charged")


@query("attempt_state", f"""WITH {ATTEMPTS_SQL}
SELECT cell_id, count(*) AS n, arg_max(status, attempt_id) AS last_status,
       arg_max(requested_max_tokens, attempt_id) AS last_max_tokens FROM attempts GROUP BY 1""")
def attempt_state(spark, folder):
    return ledger.attempt_state(attempts(spark, folder), "cell_id", "attempt_id", "status", "requested_max_tokens")


@query("attempt_number", f"""WITH {ATTEMPTS_SQL}
SELECT attempt_id, cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY attempt_id) AS attempt_number
FROM attempts""")
def attempt_number(spark, folder):
    return ledger.attempt_numbers(attempts(spark, folder).select("attempt_id", "cell_id"), ["cell_id"], "attempt_id")


@query("latest_attempt", f"""WITH {ATTEMPTS_SQL}
SELECT cell_id, attempt_id, status, accounted_cost_usd FROM attempts
QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY attempt_id DESC) = 1""")
def latest_attempt(spark, folder):
    latest = ledger.latest_attempt(attempts(spark, folder), "cell_id", "attempt_id")
    return latest.select("cell_id", "attempt_id", "status", "accounted_cost_usd")


@query("unique_requests", f"""WITH {ATTEMPTS_SQL}
SELECT attempt_id, cell_id, requested_max_tokens FROM attempts
QUALIFY row_number() OVER (PARTITION BY cell_id, requested_max_tokens ORDER BY attempt_id) = 1""")
def unique_requests(spark, folder):
    keyed = attempts(spark, folder).select(
        "attempt_id", "cell_id", "requested_max_tokens",
        keys.request_key("ledger", "generation", F.concat_ws("/", "cell_id", "requested_max_tokens")).alias("request_key"))
    return ledger.unique_requests(keyed, "request_key", "attempt_id").drop("request_key")


@query("request_keys", f"""WITH {ATTEMPTS_SQL}
SELECT attempt_id, sha256('ledger' || chr(0) || 'generation' || chr(0) || cell_id::VARCHAR) AS request_key,
       ('0x' || substr(sha256('ledger' || chr(0) || 'generation' || chr(0) || cell_id::VARCHAR), 1, 8))::BIGINT AS seed
FROM attempts""")
def request_keys(spark, folder):
    key = keys.request_key("ledger", "generation", F.col("cell_id").cast("string"))
    return attempts(spark, folder).select("attempt_id", key.alias("request_key"), keys.cell_seed(key).alias("seed"))


# Events in the shape of the state machine: views start a cell, clicks block it, the rest finish an attempt, and
# errors are transient attempts without a final status.
_EVENT_KIND = "CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'budget_blocked' ELSE 'finished' END"
_FINAL = ("CASE event_type WHEN 'purchase' THEN 'completed' "
          "WHEN 'signup' THEN (CASE WHEN accounted_cost_usd < 20 THEN 'truncated' ELSE 'failed' END) END")


def state_events(spark, folder):
    return state_events_of(attempts(spark, folder))


def state_events_of(frame):
    return frame.selectExpr(
        "attempt_id AS event_id", "cell_id", f"{_EVENT_KIND} AS kind", f"{_FINAL} AS final_status",
        "CASE WHEN requested_max_tokens % 2 = 0 THEN ' ' ELSE 'code ' || requested_max_tokens END AS event_error",
        "CASE WHEN event_type = 'purchase' THEN 'answer ' || attempt_id END AS event_content")


@query("cell_state_machine", f"""WITH {ATTEMPTS_SQL},
e AS (SELECT *, {_EVENT_KIND} AS kind, {_FINAL} AS final_status,
        trim(CASE WHEN requested_max_tokens % 2 = 0 THEN ' ' ELSE 'code ' || requested_max_tokens END) AS err,
        CASE WHEN event_type = 'purchase' THEN 'answer ' || attempt_id END AS content FROM attempts),
d AS (SELECT * FROM e WHERE kind <> 'finished' OR final_status IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY attempt_id DESC) = 1),
c AS (SELECT DISTINCT cell_id FROM attempts)
SELECT c.cell_id,
       CASE WHEN kind = 'started' THEN 'running' WHEN kind = 'budget_blocked' THEN 'budget_blocked'
            WHEN kind = 'finished' THEN final_status ELSE 'pending' END AS status,
       CASE WHEN kind = 'budget_blocked' THEN 'cumulative cost cap reached'
            WHEN kind = 'finished' AND err = '' AND final_status <> 'completed'
              THEN final_status || ': no error detail supplied'
            WHEN kind = 'finished' AND err <> '' THEN err END AS error,
       CASE WHEN kind = 'finished' THEN content END AS content
FROM c LEFT JOIN d USING (cell_id)""")
def cell_state_machine(spark, folder):
    events = state_events(spark, folder)
    cells = events.select("cell_id").distinct().select(
        "cell_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("content"))
    return ledger.fold_events(cells, events)


@query("crash_recovery", f"""WITH {ATTEMPTS_SQL},
d AS (SELECT cell_id, arg_max({_EVENT_KIND}, attempt_id) AS kind FROM attempts GROUP BY 1)
SELECT cell_id, CASE WHEN kind = 'started' THEN 'retryable' ELSE kind END AS status,
       CASE WHEN kind = 'started' THEN 'interrupted previous run' END AS error FROM d""")
def crash_recovery(spark, folder):
    last = ledger.latest_attempt(attempts(spark, folder), "cell_id", "attempt_id").selectExpr(
        "cell_id", f"CASE WHEN {_EVENT_KIND} = 'started' THEN 'running' ELSE {_EVENT_KIND} END AS status",
        "CAST(NULL AS STRING) AS error")
    return ledger.recover_interrupted(last, F.lit(None))


@query("rolling_throughput", """WITH w AS (
  SELECT event_id, ts, count(*) OVER (ORDER BY ts, event_id) AS processed, min(ts) OVER () AS first_ts,
         count(*) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3600 SECOND PRECEDING) AS bn,
         max(ts) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3600 SECOND PRECEDING) AS bt
  FROM events),
s AS (SELECT event_id, processed, processed - greatest(bn, 1) AS in_window,
             (epoch_us(ts) - epoch_us(coalesce(bt, first_ts))) / 1000000.0 AS span FROM w)
SELECT event_id, processed, in_window, CASE WHEN span > 0 THEN round(in_window / span, 9) END AS rate_per_second
FROM s""")
def rolling_throughput(spark, folder):
    rates = ledger.rolling_rate(table(spark, folder, "events"), "ts", "event_id", 3600)
    return rates.select("event_id", "processed", "in_window", F.round("rate_per_second", 9).alias("rate_per_second"))


_CENTS = "round(value * 100)::BIGINT"


@query("budget_prefix", f"""SELECT event_id, (sum({_CENTS}) OVER (ORDER BY ts, event_id))::BIGINT AS running_cents FROM events""")
def budget_prefix(spark, folder):
    from gridlens.operators.distributed import running

    requests = table(spark, folder, "events").select(
        "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    summed = running(requests, ["ts", "event_id"], {"running_cents": ("sum", F.col("cents"))})
    return summed.select("event_id", "running_cents")


@query("price_factor", f"""WITH {ATTEMPTS_SQL},
p AS (SELECT cell_id % 10 AS route, accounted_cost_usd AS reported,
        (requested_max_tokens * 0.5 + requested_max_tokens * 2.0) / 1000000 * 100000 AS baseline FROM attempts)
SELECT route, round(greatest(1.0, coalesce(max(CASE WHEN baseline > 0 AND reported > 0 THEN reported / baseline END)
         * 1.1, 1.0)), 6) AS price_factor,
       count(CASE WHEN baseline > 0 AND reported > 0 THEN 1 END) AS calibrated_on FROM p GROUP BY 1""")
def price_factor(spark, folder):
    probes = attempts(spark, folder).select(
        (F.col("cell_id") % 10).alias("route"), F.col("accounted_cost_usd").alias("reported_cost_usd"),
        F.col("requested_max_tokens").alias("input_tokens"), F.col("requested_max_tokens").alias("output_tokens"),
        F.lit(0.5 * 100_000).alias("input_price"), F.lit(2.0 * 100_000).alias("output_price"))
    factors = ledger.price_factor(probes, ["route"])
    return factors.select("route", F.round("price_factor", 6).alias("price_factor"), "calibrated_on")


@query("shared_capacity", """WITH r AS (
  SELECT s_nationkey AS provider, s_suppkey % 3 AS backend, s_suppkey % 11 + 1 AS mc, s_suppkey % 17 + 4 AS rc
  FROM supplier),
p AS (SELECT backend, provider, sum(least(8, mc)) AS demand, min(rc) AS lim FROM r GROUP BY 1, 2)
SELECT least(64000, sum(least(demand, lim)))::BIGINT AS capacity FROM p""")
def shared_capacity(spark, folder):
    routes = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("provider"), (F.col("s_suppkey") % 3).alias("backend"),
        (F.col("s_suppkey") % 11 + 1).alias("model_concurrency"), (F.col("s_suppkey") % 17 + 4).alias("route_concurrency"))
    return ledger.shared_capacity(routes, 64_000, 8)


@query("budget_estimate", """SELECT round(greatest(0.01, 12.5 + sum((greatest(1, ceil(n_chars / 2.75) + 64) * 0.3
  + 1024 * 1.2) / 1000000) * 1.1 * 1.15), 6) AS estimated_cap FROM documents""")
def budget_estimate(spark, folder):
    cost = billing.request_cost(billing.prompt_tokens(F.col("n_chars")), F.lit(1024), F.lit(0.3), F.lit(1.2))
    estimate = ledger.budget_estimate(table(spark, folder, "documents").select("n_chars"), cost, 12.5)
    return estimate.select(F.round("estimated_cap", 6).alias("estimated_cap"))


@query("realized_cost", """SELECT event_id, round(CASE
    WHEN event_type = 'click' THEN greatest(value, (k * 0.5 + 0 * 1.5) / 1000000)
    WHEN event_type = 'error' THEN 0.25 WHEN event_type = 'view' THEN value
    ELSE (k * 0.5 + k * 1.5) / 1000000 END, 9) AS cost
FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""")
def realized_cost(spark, folder):
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    kind = F.col("event_type")
    cost = billing.realized_cost(
        F.when(kind.isin("click", "view"), F.col("value")), F.when(~kind.isin("error", "view"), F.col("k")),
        F.when(~kind.isin("error", "view", "click"), F.col("k")), F.lit(0.5), F.lit(1.5), F.lit(0.25))
    return events.select("event_id", F.round(cost, 9).alias("cost"))


@query("retry_delay", """SELECT event_id, round(least(60.0, pow(2.0, user_id % 7) +
  ('0x' || substr(sha256(event_id::VARCHAR || chr(0) || (user_id % 7)::VARCHAR), 1, 4))::BIGINT / 65535.0 * 0.5), 6)
  AS delay FROM events""")
def retry_delay(spark, folder):
    delay = billing.retry_delay(F.col("event_id").cast("string"), F.col("user_id") % 7)
    return table(spark, folder, "events").select("event_id", F.round(delay, 6).alias("delay"))


@query("response_outcome", """SELECT event_id, CASE
  WHEN event_type = 'view' THEN 'invalid_response' WHEN event_type = 'error' THEN 'truncated'
  WHEN event_type = 'signup' THEN 'refused' WHEN k % 10 = 0 THEN 'reasoning_exposed' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'view' THEN 'failed' WHEN event_type = 'error' THEN 'truncated'
  WHEN event_type = 'signup' THEN 'refused' WHEN k % 10 = 0 THEN 'failed' ELSE 'completed' END AS cell_status,
  k AS output_tokens
FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""")
def response_outcome(spark, folder):
    """Outcome of chat responses in their JSON wire form."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    finish = F.when(kind == "error", "length").when(kind == "signup", "content_filter").otherwise("stop")
    reasoning = F.when(~kind.isin("view", "error", "signup") & (k % 10 == 0), "steps")
    message = F.struct(F.when(kind == "view", " ").otherwise("text").alias("content"), reasoning.alias("reasoning"))
    payload = F.to_json(F.struct(
        F.array(F.struct(message.alias("message"), finish.alias("finish_reason"))).alias("choices"),
        F.struct(k.alias("completion_tokens")).alias("usage")))
    fields = billing.response_fields(F.col("payload"))
    status = billing.attempt_status(fields)
    return table(spark, folder, "events").select("event_id", payload.alias("payload")).select(
        "event_id", status.alias("status"), billing.cell_status(status).alias("cell_status"),
        fields["output_tokens"].alias("output_tokens"))


@query("json_extract", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def judged_documents(spark, folder):
    """Documents as cells and labels as their judgments; odd labels were made from other content."""
    cells = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("cell_id"), F.lit("completed").alias("status"),
        F.col("text").alias("content"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("cell_id"), "quality", "toxic")
    judged = cells.join(labels, "cell_id").select(
        "cell_id",
        F.when(F.col("toxic") == 1, "judge-1").otherwise("judge-2").alias("judge_version"),
        F.when(F.col("quality") == 1, keys.content_key(F.col("status"), F.col("content")))
        .otherwise(keys.content_key(F.lit("running"), F.col("content"))).alias("content_hash"))
    return cells, judged


@query("stale_judgments", """SELECT d.doc_id::VARCHAR AS cell_id FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE NOT coalesce(l.toxic = 0 AND l.quality = 1, false)""")
def stale_judgments(spark, folder):
    cells, judged = judged_documents(spark, folder)
    return ledger.stale_cells(cells, judged, {"judge_version": "judge-2"}).select("cell_id")


@query("upsert_fold", """SELECT d.doc_id::VARCHAR AS cell_id,
  CASE WHEN coalesce(l.toxic = 0 AND l.quality = 1, false) THEN 'kept' ELSE 'rescored' END AS origin,
  sha256('completed' || chr(0) || d.text) AS content_hash
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def upsert_fold(spark, folder):
    """Re-score exactly the stale cells and fold the results into the stored judgments."""
    cells, judged = judged_documents(spark, folder)
    stale = ledger.stale_cells(cells, judged, {"judge_version": "judge-2"})
    fresh = stale.select("cell_id", F.lit("rescored").alias("origin"),
                         keys.content_key(F.col("status"), F.col("content")).alias("content_hash"))
    stored = judged.select("cell_id", F.lit("kept").alias("origin"), "content_hash")
    return ledger.upsert(stored, fresh, "cell_id")
