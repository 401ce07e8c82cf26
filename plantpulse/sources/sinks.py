"""Metric tables as CSV, summaries as JSON, scored rows as CSV or JSON lines."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.functions.numbers import null_nonfinite


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, absent values written as null."""
    clean = null_nonfinite(df)
    return clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def plain(value):
    """Summary values made JSON-safe: non-finite numbers become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A study summary is a few hundred numbers: one JSON document in one file."""
    text = json.dumps(plain(summary), ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_records(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    """Scoring snapshots: one JSON object (or array of objects) per file, or one per line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)
