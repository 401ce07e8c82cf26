"""Historian extracts: scan, clean, project, and keep a fresh cleaned copy."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantpulse.config import TAGS
from plantpulse.functions.tags import lenient_timestamp, serial_day_to_timestamp, to_numeric_tag
from plantpulse.session import written

SERIAL_SHARE = 0.8
INGEST = "seq"


def quoted(name: str):
    """Column by its literal name: tags contain dots and colons."""
    return F.col(f"`{name}`")


def unique_names(header: list[str]) -> list[str]:
    """Repeated headers get .1, .2, ... so that later copies can be told apart."""
    seen: dict[str, int] = {}
    names = []
    for raw in header:
        count = seen.get(raw, 0)
        seen[raw] = count + 1
        names.append(f"{raw}.{count}" if count else raw)
    return names


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", ingest_order: bool = True,
    names: list[str] | None = None, corrupt: str | None = None,
) -> DataFrame:
    """Every column as text: mixed tags would break inference.

    ``names`` are the columns of files without a header line.  ``corrupt`` adds a column with
    the whole line of rows that have more or fewer fields than the header, see
    ``split_malformed``.  ``seq`` keeps the reading order for keep-first rules and ties in
    time.
    """
    header = names is None
    if header:
        line = spark.read.text(path).first()
        if line is None:
            raise ValueError(f"{path} is empty")
        names = unique_names(next(csv.reader([line["value"]], delimiter=sep)))
    columns = [*names, *([corrupt] if corrupt else [])]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
    reader = spark.read.schema(schema).option("header", header).option("sep", sep)
    if corrupt:
        # All fields are parsed, or a line is only as malformed as the columns asked for.
        reader = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
    df = reader.csv(path)
    return with_ingest_order(df) if ingest_order else df


def split_malformed(df: DataFrame, corrupt: str) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, quarantine): the latter are the lines as they stand in the file.

    The parsed rows are written, so that both sides come from one reading of the files.
    """
    df = written(df, "parsed")
    bad = quoted(corrupt).isNotNull()
    return df.filter(~bad).drop(corrupt), df.filter(bad).select(quoted(corrupt).alias("line"))


def with_ingest_order(df: DataFrame, name: str = INGEST) -> DataFrame:
    """Reading order as one sortable text: file, place of the block in it, row of the task.

    Row numbers hold for one scan; write the table before it is read twice.
    """
    place = F.concat(
        F.col("_metadata.file_path"),
        F.format_string("#%015d#%019d", F.col("_metadata.file_block_start"), F.monotonically_increasing_id()),
    )
    return df.withColumn(name, place)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def clean_table(
    df: DataFrame, time: str = "Time", seq: str = INGEST, unit: str | None = None
) -> DataFrame:
    """Typed, de-duplicated table: one row per (unit,) time, numeric tags, no empty column.

    A single aggregate decides what depends on the data (the time format and the
    columns without any reading); everything else is a projection and one grouping.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    require_columns(df, [time])
    if seq not in df.columns:
        df = df.withColumn(seq, F.monotonically_increasing_id())
    fixed = [c for c in (unit, time, seq) if c]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tags = [c for c in df.columns if c not in fixed and not c.endswith(".1")]
    readings = {c: to_numeric_tag(quoted(c), kinds[c]) for c in tags}
    already_time = isinstance(kinds[time], (T.TimestampType, T.TimestampNTZType))
    serial = F.lit(None).cast("double") if already_time else to_numeric_tag(quoted(time), kinds[time])
    facts = df.agg(
        F.avg(F.when(serial.isNotNull(), 1.0).otherwise(0.0)).alias("_serial"),
        *[F.count(expr).alias(str(i)) for i, expr in enumerate(readings.values())],
    ).first()
    if already_time:
        when = quoted(time).cast("timestamp")
    elif (facts["_serial"] or 0.0) > SERIAL_SHARE:
        when = serial_day_to_timestamp(serial)
    else:
        when = lenient_timestamp(quoted(time).cast("string"))
    filled = [c for i, c in enumerate(tags) if facts[str(i)] > 0]
    typed = df.select(
        *([quoted(unit)] if unit else []),
        when.alias(time),
        quoted(seq),
        *[readings[c].alias(c) for c in filled],
    ).filter(quoted(time).isNotNull())
    return keep_first(typed, [*([unit] if unit else []), time], seq)


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, the earliest by ``seq``; map-side combine absorbs hot keys."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[quoted(c) for c in rest])
    kept = df.groupBy(*[quoted(k) for k in keys]).agg(F.min_by(row, quoted(seq)).alias("_row"))
    return kept.select(
        *[quoted(k) for k in keys], *[F.col("_row").getField(c).alias(c) for c in rest]
    ).select(*[quoted(c) for c in df.columns])


def modeling_table(df: DataFrame, time: str, target_tag: str, seq: str = INGEST) -> DataFrame:
    """Project tags onto model columns; contrast tags stay when the extract has them."""
    roles = {tag: (alias, role) for tag, _, alias, role in TAGS if alias}
    drivers = [tag for tag, (_, role) in roles.items() if role == "driver"]
    contrasts = [t for t, (_, role) in roles.items() if role == "contrast" and t in df.columns]
    require_columns(df, [time, target_tag, *drivers])
    target_alias = next(a for a, role in roles.values() if role == "target")
    return df.select(
        quoted(time),
        *([quoted(seq)] if seq in df.columns else []),
        quoted(target_tag).alias(target_alias),
        *[quoted(t).alias(roles[t][0]) for t in [*drivers, *contrasts]],
    )


def tag_dimension(spark: SparkSession) -> DataFrame:
    """(tag, description, alias, role): a fixed table of about thirty rows."""
    return spark.createDataFrame(TAGS, "tag string, description string, alias string, role string")


def last_modified(spark: SparkSession, path: str):
    """Newest file time under a path, from the listing alone; None when absent."""
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return listing.agg(F.max("modificationTime")).first()[0]


def load_historian(
    spark: SparkSession, source: str, cache: str, time: str, target_tag: str
) -> DataFrame:
    """Cleaned model table; rebuilt only when the extract is newer than the copy."""
    stamp = last_modified(spark, source)
    if stamp is None:
        raise FileNotFoundError(source)
    kept = last_modified(spark, cache)
    if kept is None or kept < stamp:
        table = modeling_table(clean_table(read_csv(spark, source), time), time, target_tag)
        table.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)
