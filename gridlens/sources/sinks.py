"""Result files: canonical JSON lines, tidy and matrix CSV, and small JSON or text documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions.keys import canonical_json_text
from gridlens.session import child_numbers, file_system


def write_document(spark: SparkSession, path: str, value: dict | list | str) -> None:
    """One small document beside the tables, in whatever store they lie; numbers that are not finite become null.

    It is written under another name first and renamed, so a reader finds the old or the new one.
    """
    text = value if isinstance(value, str) else json.dumps(
        json.loads(canonical_json_text(value)), indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    system, target = file_system(spark, path)
    _, draft = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.exists(target):
        system.delete(target, False)
    system.rename(draft, target)


def publish(frame: DataFrame, root: str) -> str:
    """Write the next version of a table, which may have been made from the one before; its folder."""
    spark = frame.sparkSession
    version = max(child_numbers(spark, root, "version-"), default=0) + 1
    frame.write.parquet(f"{root}/version-{version}")
    return f"{root}/version-{version}"


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete version of a published table; None if there is none."""
    versions = child_numbers(spark, root, "version-")
    return spark.read.parquet(f"{root}/version-{versions[-1]}") if versions else None


def write_jsonl(frame: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """JSON lines with sorted keys, one file per partition of the ordered frame."""
    fields = [F.col(c) for c in sorted(frame.columns)]
    ordered = frame.orderBy(*order) if order else frame
    finite = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c).alias(name)
              if isinstance(frame.schema[name].dataType, T.DoubleType) else c
              for c, name in zip(fields, sorted(frame.columns))]
    ordered.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite").text(folder)


@F.pandas_udf(T.StringType())
def short_number(value: pd.Series) -> pd.Series:
    """Twelve significant digits without trailing zeros, which Java formatting does not offer."""
    return value.map(lambda x: None if pd.isna(x) else f"{x:.12g}")


def write_csv(frame: DataFrame, folder: str, order: list[str]) -> None:
    """CSV with a header, short numbers and empty cells for missing values."""
    columns = [short_number(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
               for f in frame.schema.fields]
    ordered = frame.orderBy(*order).select(*columns)
    ordered.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(folder)


def contrast_report(contrasts: DataFrame, family: str, title: str) -> str:
    """Readable lines of one family of contrasts."""
    rows: Iterator = contrasts.filter(F.col("family") == family).orderBy("outcome_index", "group_value").toLocalIterator()

    def shown(value, digits: int = 4) -> str:
        return "NA" if value is None else f"{value:.{digits}f}"

    lines = [title, "-" * len(title)]
    for row in rows:
        p = "NA" if row["p_value"] is None else "<0.0001" if row["p_value"] < 1e-4 else shown(row["p_value"])
        group = f" [{row['group_value']}]" if row["group_value"] else ""
        lines.append(f"{row['outcome']}{group}: {shown(row['effect'])} ({shown(row['ci_low'])} to "
                     f"{shown(row['ci_high'])}), p={p}, questions={row['question_clusters']}")
    return "\n".join(lines) + "\n"
