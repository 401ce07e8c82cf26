"""Column expressions that turn acquisition text into numbers, times and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F, types as T

from plantpulse.config import ACQUISITION_MARKERS, COMPASS_POINTS, NO_DIRECTION

# A decimal literal and nothing else: the engine's own cast also takes '1.25d',
# hexadecimal floats and 'nan', none of which is a reading.
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Spreadsheet serial days count from 1899-12-30; this is 1970-01-01 on that scale.
_SERIAL_EPOCH = 25569
_DAY_MICROS = 86_400_000_000


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so there is one notion of missing."""
    return F.when(F.abs(c) < F.lit(math.inf), c)


def lenient_number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal is NULL."""
    text = F.trim(c.cast("string"))
    return finite(F.when(text.rlike(_DECIMAL), text.try_cast("double")))


def to_numeric_tag(c: Column, dtype: T.DataType | None = None) -> Column:
    """Reading of a tag: numeric columns pass, acquisition markers become NULL."""
    if dtype is not None and isinstance(dtype, T.NumericType):
        return finite(c.cast("double"))
    text = F.lower(F.trim(c.cast("string")))
    return F.when(~text.isin(ACQUISITION_MARKERS), lenient_number(c))


def serial_day_to_timestamp(days: Column) -> Column:
    """Spreadsheet serial day to a timestamp, rounded to the microsecond."""
    return F.timestamp_micros(F.round((days - _SERIAL_EPOCH) * _DAY_MICROS).cast("long"))


def lenient_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def is_missing_direction(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin(NO_DIRECTION)


def compass_degrees(c: Column) -> Column:
    """Compass point to degrees clockwise from north; unknown text is NULL."""
    step = 360.0 / len(COMPASS_POINTS)
    position = F.array_position(F.array(*[F.lit(p) for p in COMPASS_POINTS]), F.trim(c))
    return F.when(position > 0, (position - 1) * F.lit(step))


def epoch_micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(60_000_000.0)
