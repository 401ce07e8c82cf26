"""Small numeric column helpers used by reports and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantpulse.config import CLASSES, PSI_BANDS, PSI_MODERATE, PSI_STABLE
from plantpulse.functions.tags import finite


def round4(c: Column) -> Column:
    """Four decimals, ties to even."""
    return F.bround(c, 4)


def safe_ratio(value: Column, level: Column) -> Column:
    """value / level, NULL where the level is zero."""
    return F.try_divide(value, level)


def formatted(c: Column, digits: int = 4, missing: str = "s/d") -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise(missing)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def date_prefix(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def psi_band(c: Column) -> Column:
    stable, moderate, drift, unknown = PSI_BANDS
    return (
        F.when(finite(c).isNull(), unknown)
        .when(c < PSI_STABLE, stable)
        .when(c < PSI_MODERATE, moderate)
        .otherwise(drift)
    )


def degradation_class(residual: Column, alert: Column | float, critical: Column | float) -> Column:
    """Grade a residual against two inclusive limits; a missing residual has no grade."""
    normal, warn, crit = CLASSES
    return (
        F.when(residual.isNull() | F.isnan(residual), F.lit(None).cast("string"))
        .when(residual <= alert, normal)
        .when(residual <= critical, warn)
        .otherwise(crit)
    )


def significant(p_value: Column, level: float = 0.05) -> Column:
    return F.when(p_value.isNotNull(), p_value < level)


def null_nonfinite(df: DataFrame) -> DataFrame:
    """Every floating column with NaN and infinities replaced by NULL."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            finite(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
