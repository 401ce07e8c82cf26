"""One-minute extract of the air-cooled unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from plantpulse.config import AIR_COOLED, RATED_MW
from plantpulse.functions.tags import (
    compass_degrees, is_missing_direction, lenient_number, lenient_timestamp,
)
from plantpulse.session import written
from plantpulse.sources.historian import INGEST, read_csv


def prepare_air_cooled(df: DataFrame, rated_mw: float = RATED_MW) -> DataFrame:
    """Model columns of the extract; rows lacking time, target or a driver are dropped.

    Power is capacity factor times rating; wind direction becomes sine and cosine.
    """
    stamp = "Time" if "Time" in df.columns else "date"
    direction = F.when(~is_missing_direction(F.col("Wind_dir")), F.trim("Wind_dir"))
    degrees = compass_degrees(direction)
    angle = F.radians(degrees)
    prepared = df.select(
        lenient_timestamp(F.col(stamp).cast("string")).alias("Time"),
        *([F.col(INGEST)] if INGEST in df.columns else []),
        lenient_number(F.col("TV_BP_Pout")).alias("vacio"),
        (lenient_number(F.col("CF")) * rated_mw).alias("potencia_mw"),
        lenient_number(F.col("T_ambient")).alias("temp_ambiente"),
        lenient_number(F.col("Wind_speed")).alias("viento"),
        lenient_number(F.col("BP_Flow")).alias("flujo_bp"),
        lenient_number(F.col("TV_BP_Tout")).alias("temp_salida_bp"),
        F.sin(angle).alias("viento_sin"),
        F.cos(angle).alias("viento_cos"),
        F.when(degrees.isNotNull(), direction).alias("direccion"),
        lenient_number(F.col("CF")).alias("cf"),
    )
    return prepared.dropna(subset=["Time", "vacio", *AIR_COOLED.drivers])


def load_air_cooled(
    spark: SparkSession, path: str, rated_mw: float = RATED_MW
) -> tuple[DataFrame, dict]:
    """Prepared table and its row counts, both from one scan of the extract.

    The table is written, which fixes the reading order of rows with equal times.
    """
    seen = Observation()
    raw = read_csv(spark, path).observe(seen, F.count("*").alias("n"))
    prepared = written(prepare_air_cooled(raw, rated_mw), "air-cooled")
    facts = {
        "filas_archivo": seen.get["n"],
        "filas_validas": prepared.count(),
        "potencia_nominal_mw": float(rated_mw),
    }
    return prepared, facts
