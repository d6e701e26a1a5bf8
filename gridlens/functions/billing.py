"""Prices, token estimates, retry delays and response outcomes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the acquisition ledger.
CHARACTERS_PER_TOKEN = 2.75
PROMPT_OVERHEAD_TOKENS = 64
BUDGET_SAFETY = 1.10
BUDGET_HEADROOM = 1.15
TRUNCATION_REASONS = ("length", "max_tokens", "max_output_tokens")
SAFETY_REASONS = ("content_filter", "safety", "blocked")
TRANSIENT_HTTP = (408, 409, 425, 429, 500, 502, 503, 504)
REASONING_FIELDS = ("reasoning", "reasoning_content", "thinking", "reasoning_details")
HTTP_DATE_FORMATS = ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEEE, dd-MMM-yyyy HH:mm:ss 'GMT'", "EEE MMM d HH:mm:ss yyyy")


def prompt_tokens(characters: Column) -> Column:
    """Conservative token estimate of a prompt."""
    return F.greatest(F.lit(1), F.ceil(characters / F.lit(CHARACTERS_PER_TOKEN)) + F.lit(PROMPT_OVERHEAD_TOKENS))


def request_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Cost in dollars at prices per million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / F.lit(1_000_000.0)


def realized_cost(reported: Column, input_tokens: Column, output_tokens: Column, input_price: Column,
                  output_price: Column, reservation: Column) -> Column:
    """The larger of reported and derived cost; the reservation when neither is known."""
    known = input_tokens.isNotNull() | output_tokens.isNotNull()
    derived = F.when(known, request_cost(F.coalesce(input_tokens, F.lit(0)), F.coalesce(output_tokens, F.lit(0)),
                                         input_price, output_price))
    return F.coalesce(F.greatest(reported, derived), reservation)


def retry_delay(request_key: Column, attempt: Column, retry_after: Column | None = None,
                now: Column | None = None) -> Column:
    """Exponential backoff with hashed jitter, raised to the server's Retry-After where one is given."""
    digest = F.sha2(F.concat(request_key, F.lit("\0"), attempt.cast("string")), 256)
    jitter = F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / F.lit(65535.0) * F.lit(0.5)
    backoff = F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt) + jitter)
    if retry_after is None:
        return backoff
    moment = now if now is not None else F.current_timestamp()
    date = F.coalesce(*[F.try_to_timestamp(_date_text(retry_after, f), F.lit(_date_format(f)))
                        for f in HTTP_DATE_FORMATS])
    seconds = F.coalesce(retry_after.try_cast("double"),
                         (F.unix_micros(date) - F.unix_micros(moment)) / F.lit(1_000_000.0))
    bounded = F.least(F.lit(120.0), F.greatest(F.lit(0.0), seconds))
    return F.when(seconds.isNotNull(), F.greatest(backoff, bounded)).otherwise(backoff)


def _date_format(full: str) -> str:
    """Spark does not parse week days, so both the value and its format start after them."""
    return full.split(", ", 1)[1] if ", " in full else full.split(" ", 1)[1]


def _date_text(value: Column, full: str) -> Column:
    if ", " in full:
        rest = F.regexp_extract(value, r"^[A-Za-z]+, (.*)$", 1)
        # Two-digit years from 69 on belong to the last century.
        return F.regexp_replace(F.regexp_replace(rest, r"-(69|[7-9]\d) ", "-19$1 "), r"-(\d\d) ", "-20$1 ")
    return F.regexp_replace(F.regexp_extract(value, r"^[A-Za-z]{3} (.*)$", 1), r"\s+", " ")


def _present(payload: Column, path: str) -> Column:
    value = F.get_json_object(payload, path)
    return value.isNotNull() & ~value.isin("", "[]", "{}", "null")


def response_fields(payload: Column) -> dict[str, Column]:
    """Visible text, usage and end state of a chat response stored as JSON."""
    def number(path: str, kind: str) -> Column:
        value = F.get_json_object(payload, path).try_cast(kind)
        return F.when(value >= 0, value)

    message = "$.choices[0].message"
    content = F.get_json_object(payload, f"{message}.content")
    details = number("$.usage.completion_tokens_details.reasoning_tokens", "bigint")
    lowered = F.lower(content)
    reasoning = F.coalesce(
        *[F.when(_present(payload, f"{message}.{name}"), F.lit(name)) for name in REASONING_FIELDS],
        F.when(lowered.contains("<think>") | lowered.contains("</think>"), F.lit("inline think tag")),
        F.when(details > 0, F.lit("reasoning tokens")),
    )
    refusal = F.get_json_object(payload, f"{message}.refusal")
    return {
        "content": F.when(F.trim(content) != "", content),
        "input_tokens": number("$.usage.prompt_tokens", "bigint"),
        "output_tokens": number("$.usage.completion_tokens", "bigint"),
        "reported_cost_usd": number("$.usage.cost", "double"),
        "provider": F.get_json_object(payload, "$.provider"),
        "finish_reason": F.lower(F.get_json_object(payload, "$.choices[0].finish_reason")),
        "refusal": F.when(_present(payload, f"{message}.refusal"), refusal),
        "reasoning": reasoning,
    }


def attempt_status(fields: dict[str, Column]) -> Column:
    """Outcome precedence of a transported response."""
    finish = fields["finish_reason"]
    return (
        F.when(fields["content"].isNull(), "invalid_response")
        .when(fields["reasoning"].isNotNull(), "reasoning_exposed")
        .when(finish.isin(list(TRUNCATION_REASONS)), "truncated")
        .when(finish.isin(list(SAFETY_REASONS)) | fields["refusal"].isNotNull(), "refused")
        .when(finish.isNull() | (finish != "stop"), "invalid_response")
        .otherwise("completed")
    )


def transport_status(error_kind: Column, http_status: Column) -> Column:
    """Attempt status of a failed request from its exception family and HTTP code."""
    return (
        F.when(error_kind == "timeout", "timeout")
        .when(error_kind == "network", "network_error")
        .when((error_kind == "http_status") | http_status.isNotNull(), "http_error")
        .when(error_kind.isin("value", "type", "key"), "invalid_response")
        .otherwise("failed")
    )


def cell_status(attempt: Column) -> Column:
    """Terminal cell status of an attempt status."""
    return F.when(attempt.isin("completed", "truncated", "refused"), attempt).otherwise("failed")


def is_transient(http_status: Column) -> Column:
    return http_status.isin(list(TRANSIENT_HTTP))


def rate_limit_origin(backend: Column, provider: Column, payload: Column, headers: Column, *,
                      relay: str) -> Column:
    """Who rejected a rate-limited request, judged only by explicit provenance."""
    named = F.coalesce(*[F.when(F.trim(F.get_json_object(payload, f"$.error.metadata.{k}")) != "",
                                F.trim(F.get_json_object(payload, f"$.error.metadata.{k}")))
                         for k in ("provider_name", "provider", "provider_slug")])
    message = F.lower(F.coalesce(F.get_json_object(payload, "$.error.message"), F.lit("")))
    relayed = F.exists(headers, lambda name: F.lower(name).startswith(f"x-{relay}")) | message.contains(relay)
    return (
        F.when(backend != relay, F.concat(F.lit("unknown-via-"), backend, F.lit(":"), provider))
        .when(named.isNotNull(), F.concat(F.lit("upstream:"), named))
        .when(relayed, F.lit(relay))
        .otherwise(F.lit(f"unknown-via-{relay}"))
    )
