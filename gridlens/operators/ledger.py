"""Attempt ledger, cell state and incremental re-scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.functions import billing, keys
from gridlens.operators.distributed import first_per_key, running

CELL_RESULT = ("provider", "content", "error", "input_tokens", "output_tokens", "latency_seconds",
               "raw_response_json")


def attempt_numbers(attempts: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Number the attempts of each cell in arrival order."""
    return running(attempts, [order], {"attempt_number": ("sum", F.lit(1).cast("bigint"))}, keys=key)


def attempt_state(attempts: DataFrame, key: str, order: str, status: str, ceiling: str) -> DataFrame:
    """Attempt count with the latest status and output ceiling of every cell."""
    latest = F.struct(F.col(status).alias("last_status"), F.col(ceiling).alias("last_max_tokens"))
    state = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by(latest, order).alias("last"))
    return state.select(key, "n", "last.last_status", "last.last_max_tokens")


def latest_attempt(attempts: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(attempts, [key], order, last=True)


def unique_requests(attempts: DataFrame, request_key: str, order: str) -> DataFrame:
    """First attempt of every request key; later copies of a request are duplicates."""
    return first_per_key(attempts, [request_key], order)


def spend(attempts: DataFrame, cost: str) -> DataFrame:
    return attempts.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("spend"), F.count(cost).alias("charged"))


def pending(cells: DataFrame, questions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Open cells of the chosen models with their question, in schedule order.

    Both sides are shuffled: a table of questions that looks small as a file would pass whole through the driver.
    """
    open_cells = cells.filter(F.col("status").isin(list(P.OPEN_STATUSES)) & F.col("model_id").isin(list(models)))
    return open_cells.join(questions.hint("merge"), "question_id").orderBy(keys.schedule_key(F.col("cell_id")))


def recover_interrupted(cells: DataFrame, completed_at: Column) -> DataFrame:
    """Cells left running by a dead process become retryable and lose their partial result."""
    interrupted = F.col("status") == "running"
    fields = []
    for field in cells.schema.fields:
        if field.name == "status":
            fields.append(F.when(interrupted, "retryable").otherwise(F.col("status")).alias("status"))
        elif field.name == "error":
            fields.append(F.when(interrupted, "interrupted previous run").otherwise(F.col("error")).alias("error"))
        elif field.name == "completed_at":
            fields.append(F.when(interrupted, completed_at).otherwise(F.col("completed_at")).alias("completed_at"))
        elif field.name in CELL_RESULT:
            fields.append(F.when(~interrupted, F.col(field.name)).alias(field.name))
        else:
            fields.append(F.col(field.name))
    return cells.select(*fields)


def stale_cells(cells: DataFrame, judgments: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Cells whose judgment is missing or was made from other versions or other content.

    Content is hashed before the join, so only ids and digests meet; the rows of stale cells are fetched by id.
    """
    known = judgments.select("cell_id", F.col("content_hash").alias("_known"),
                             *[F.col(name).alias(f"_made_{i}") for i, name in enumerate(versions)])
    hashed = cells.select("cell_id", keys.content_key(F.col("status"), F.col("content")).alias("_hash"))
    current = F.col("_known").eqNullSafe(F.col("_hash"))
    for i, value in enumerate(versions.values()):
        current = current & F.col(f"_made_{i}").eqNullSafe(F.lit(value))
    stale = hashed.join(known, "cell_id", "left").filter(~current).select("cell_id").distinct()
    return cells.join(stale, "cell_id", "left_semi").select(*cells.columns)


def upsert(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace rows by key: the log of earlier rows without the updated keys, then the updates."""
    return existing.join(updates.select(key), key, "left_anti").unionByName(updates)


def fold_events(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Apply started, finished and budget-blocked events to the cells they name.

    Only the last state-changing event of a cell matters: a start clears the result, a finish with a final status
    writes it, a budget stop records its fixed error.  An attempt without a final status leaves the cell alone.
    """
    deciding = events.filter((F.col("kind") != "finished") | F.col("final_status").isNotNull())
    last = first_per_key(deciding, ["cell_id"], "event_id", last=True)
    kind = F.col("kind")
    finished = kind == "finished"
    blank = F.coalesce(F.trim(F.col("event_error")), F.lit("")) == ""
    needs_error = F.col("final_status").isin("failed", "retryable", "truncated", "refused")
    error = (
        F.when(kind == "budget_blocked", "cumulative cost cap reached")
        .when(finished & blank & needs_error, F.concat(F.col("final_status"), F.lit(": no error detail supplied")))
        .when(finished & ~blank, F.trim(F.col("event_error")))
    )
    state = last.select(
        "cell_id",
        F.when(kind == "started", "running").when(kind == "budget_blocked", "budget_blocked")
        .otherwise(F.col("final_status")).alias("new_status"),
        error.alias("new_error"),
        F.when(finished, F.col("event_content")).alias("new_content"),
        F.lit(True).alias("touched"),
    )
    joined = cells.join(state, "cell_id", "left")
    touched = F.coalesce("touched", F.lit(False))
    return joined.select(
        *[c for c in cells.columns if c not in ("status", "error", "content")],
        F.when(touched, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(touched, F.col("new_error")).otherwise(F.col("error")).alias("error"),
        F.when(touched, F.col("new_content")).otherwise(F.col("content")).alias("content"),
    )


def rolling_rate(events: DataFrame, time: str, row_id: str, window_seconds: float) -> DataFrame:
    """Throughput at every event against the last event at or before the window's start.

    Each event also sends a probe to its window start; one global order of events and probes gives the count and
    the time of the boundary event as running values.  Before the first full window the first event is the boundary.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    width = int(window_seconds * 1_000_000)
    base = events.select(F.col(row_id).alias("_id"), micros.alias("_t"))
    points = base.select("_id", "_t", F.explode(F.array(
        F.struct(F.lit(0).alias("probe"), F.col("_t").alias("at")),
        F.struct(F.lit(1).alias("probe"), (F.col("_t") - width).alias("at")))).alias("p")
    ).select("_id", "_t", "p.probe", "p.at")
    event = F.col("probe") == 0
    scanned = running(points, ["at", "probe", "_id"], {
        "count": ("sum", F.when(event, 1).otherwise(0).cast("bigint")),
        "seen": ("max", F.when(event, F.col("at"))),
        "first": ("min", F.when(event, F.col("at"))),
    })
    # The two rows of an event meet again on its unique id.
    paired = scanned.groupBy("_id").agg(
        F.max(F.when(event, F.col("count"))).alias("n"), F.max(F.when(event, F.col("at"))).alias("t"),
        F.max(F.when(event, F.col("first"))).alias("first"),
        F.max(F.when(~event, F.col("count"))).alias("boundary_n"), F.max(F.when(~event, F.col("seen"))).alias("boundary_t"),
    )
    start_n = F.greatest(F.col("boundary_n"), F.lit(1))
    start_t = F.coalesce("boundary_t", "first")
    span = (F.col("t") - start_t) / F.lit(1_000_000.0)
    return paired.select(
        F.col("_id").alias(row_id), F.col("n").alias("processed"), (F.col("n") - start_n).alias("in_window"),
        F.when(span > 0, (F.col("n") - start_n) / span).alias("rate_per_second"),
    )


def budget_estimate(open_requests: DataFrame, cost: Column, spent: float) -> DataFrame:
    """Cost cap covering what was spent and one pass over the open requests."""
    factor = F.lit(billing.BUDGET_SAFETY * billing.BUDGET_HEADROOM)
    return open_requests.agg(
        F.greatest(F.lit(0.01), F.lit(spent) + F.coalesce(F.sum(cost), F.lit(0.0)) * factor).alias("estimated_cap"))


def price_factor(attempts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Billing calibration per route: at least one, else 1.1 times the worst reported-to-derived ratio."""
    baseline = billing.request_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"),
                                    F.col("output_price"))
    ratio = F.when((baseline > 0) & (F.col("reported_cost_usd") > 0), F.col("reported_cost_usd") / baseline)
    return attempts.groupBy(*key).agg(
        F.greatest(F.lit(1.0), F.coalesce(F.max(ratio) * 1.10, F.lit(1.0))).alias("price_factor"),
        F.count(ratio).alias("calibrated_on"))


def shared_capacity(routes: DataFrame, concurrency: int, per_model: int) -> DataFrame:
    """Request ceiling after model limits and the limits of providers that models share."""
    demand = F.least(F.lit(per_model), F.col("model_concurrency"))
    providers = routes.groupBy("backend", "provider").agg(
        F.sum(demand).alias("demand"), F.min("route_concurrency").alias("limit"))
    return providers.agg(F.least(F.lit(concurrency), F.sum(F.least("demand", "limit"))).alias("capacity"))


def bottlenecks(routes: DataFrame) -> DataFrame:
    """Constrained routes, the most constrained first."""
    unconstrained = F.least("route_concurrency", "model_concurrency")
    limit = F.least(F.col("current_limit"), unconstrained)
    saturated = (limit < unconstrained) & (F.col("active") >= limit)
    return routes.filter(saturated | (F.col("cooldown") > 0)).withColumn("ratio", limit / unconstrained).orderBy(
        "ratio", F.desc("cooldown"), "model_id")


def ceiling_rules() -> dict[str, Column]:
    """Release rules of an output ceiling against the largest observed output and the model's capability."""
    ceiling = F.col("output_ceiling")
    return {
        "ceiling_has_headroom": ceiling >= F.col("observed_max") * 1.25,
        "ceiling_is_multiple_of_256": ceiling % 256 == 0,
        "ceiling_within_capability": ceiling <= F.col("capability"),
    }
