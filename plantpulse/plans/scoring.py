"""Scoring of operating records: the same transform serves files and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plantpulse.config import OBSERVED_FIELD, RECORD_FIELDS
from plantpulse.functions.numbers import degradation_class, round4
from plantpulse.functions.tags import finite, lenient_number
from plantpulse.sources.bundle import ScoringBundle
from plantpulse.sources.historian import read_csv, require_columns
from plantpulse.sources.sinks import write_csv

OBSERVED = OBSERVED_FIELD[0]

RECORD_SCHEMA = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in RECORD_FIELDS] + [T.StructField(OBSERVED, T.DoubleType())]
)


def reject_reasons(
    fields: dict = RECORD_FIELDS, observed: tuple = OBSERVED_FIELD
) -> Column:
    """Names of the fields that are missing or outside their inclusive bounds."""
    tests = []
    for name, (_, low, high) in fields.items():
        ok = F.coalesce(F.col(name).between(low, high), F.lit(False))
        tests.append(F.when(~ok, F.lit(name)))
    name, low, high = observed
    tests.append(F.when(~F.col(name).between(low, high), F.lit(name)))
    return F.filter(F.array(*tests), lambda r: r.isNotNull())


def validate_records(
    df: DataFrame, fields: dict = RECORD_FIELDS, observed: tuple = OBSERVED_FIELD
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows carry ``reject_reason``."""
    marked = df.withColumn("reject_reason", reject_reasons(fields, observed))
    clean = F.size("reject_reason") == 0
    return marked.filter(clean).drop("reject_reason"), marked.filter(~clean)


def score_records(
    df: DataFrame, bundle: ScoringBundle, fields: dict = RECORD_FIELDS, observed: str = OBSERVED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Expected values, and residuals, class and anomaly flag where a reading exists.

    The output schema is fixed: without an observed value its columns are NULL.
    """
    keep = list(keep or [])
    renamed = df.select(
        *keep,
        *[F.col(f).cast("double").alias(alias) for f, (alias, _, _) in fields.items()],
        finite(F.col(observed).cast("double")).alias("_observed"),
    )
    both = bundle.expected(renamed, "_expected").withColumn("_base", bundle.baseline.predicted())
    seen = F.col("_observed")
    above_base = seen - F.col("_base")
    return both.select(
        *keep,
        round4(F.col("_expected")).alias("vacio_esperado"),
        round4(F.col("_base")).alias("vacio_linea_base_agua_carga"),
        F.lit(bundle.model_name).alias("modelo"),
        round4(seen).alias("vacio_observado"),
        round4(seen - F.col("_expected")).alias("residual_modelo"),
        round4(above_base).alias("residual_linea_base"),
        degradation_class(above_base, F.lit(bundle.alert), F.lit(bundle.critical)).alias("clase"),
        (above_base > bundle.critical).alias("anomalia"),
        F.when(seen.isNotNull(), round4(F.lit(float(bundle.critical)))).alias("umbral_anomalia"),
    )


def read_batch(
    spark: SparkSession, path: str, fields: dict = RECORD_FIELDS, observed: str = OBSERVED
) -> DataFrame:
    """Records from CSV: file type, presence of rows and required columns are checked."""
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError("the batch must be a CSV file")
    df = read_csv(spark, path, ingest_order=False)
    require_columns(df, list(fields))
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    seen = F.col(observed) if observed in df.columns else F.lit(None).cast("string")
    return df.select(
        *[lenient_number(F.col(f)).alias(f) for f in fields], lenient_number(seen).alias(observed)
    )


def score_file(
    spark: SparkSession, bundle: ScoringBundle, path: str, out: str, fields: dict = RECORD_FIELDS,
    observed: str = OBSERVED,
) -> DataFrame:
    """Score a CSV of records and write the scored rows as CSV."""
    scored = score_records(read_batch(spark, path, fields, observed), bundle, fields, observed)
    write_csv(scored, out)
    return scored


def service_counters(scored: DataFrame, by: list | None = None) -> DataFrame:
    """Predictions and anomalies; a record without a reading is not an anomaly."""
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("predicciones"),
        F.count_if(F.coalesce("anomalia", F.lit(False))).alias("anomalias"),
    )
