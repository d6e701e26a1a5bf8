"""Stable SHA-256 keys and the numbers derived from them."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Version prefixes that are part of the keys.
CELL_KEY_PREFIX = "cell-v2"
SCHEDULE_KEY_PREFIX = "sha256-balanced-cell-order-v1"

_NUL = "\0"


def _joined(*parts: Column | str) -> Column:
    columns = []
    for index, part in enumerate(parts):
        if index:
            columns.append(F.lit(_NUL))
        columns.append(F.lit(part) if isinstance(part, str) else part)
    return F.concat(*columns)


def hash_key(*parts: Column | str) -> Column:
    """Lower-case hexadecimal SHA-256 of NUL-separated parts (strings are literals)."""
    return F.sha2(_joined(*parts), 256)


def cell_key(question: Column, model: Column, condition: Column) -> Column:
    return hash_key(CELL_KEY_PREFIX, question, model, condition)


def schedule_key(cell: Column) -> Column:
    return hash_key(SCHEDULE_KEY_PREFIX, cell)


def content_key(status: Column, content: Column) -> Column:
    return hash_key(status, F.coalesce(content, F.lit("")))


def request_key(namespace: str, phase: Column | str, identifier: Column) -> Column:
    """Idempotency key of one request; the namespace keeps experiments apart."""
    return hash_key(namespace, phase, identifier)


def cell_seed(key: Column) -> Column:
    """Sampling seed of a cell: the first eight hexadecimal digits as an integer."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash_parity(key: Column) -> Column:
    """0 or 1 from the last hexadecimal digit, for balanced side assignment."""
    return (F.conv(F.substring(key, 64, 1), 16, 10).cast("int") % 2).cast("int")


def _finite(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {key: _finite(item) for key, item in value.items()}
    if isinstance(value, (list, tuple)):
        return [_finite(item) for item in value]
    return value


def canonical_json_text(value) -> str:
    """Sorted keys, no blanks, non-finite numbers as null."""
    return json.dumps(_finite(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256_text(value) -> str:
    return hashlib.sha256(canonical_json_text(value).encode("utf-8")).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Rewrite JSON text canonically; number formatting differs between engines, hence Python."""
    return text.map(lambda item: None if item is None else canonical_json_text(json.loads(item)))
