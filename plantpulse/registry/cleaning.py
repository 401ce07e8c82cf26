"""Ingestion, cleaning, scalar conversions, regime filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.config import COMPASS_POINTS, INHG_TO_MBAR, TAGS
from plantpulse.functions.numbers import date_prefix, formatted, safe_ratio, thousands
from plantpulse.functions.tags import compass_degrees, is_missing_direction
from plantpulse.operators.regime import operating_rows, quality_report, terminal_difference
from plantpulse.registry.views import RD_SQL, READINGS, naive, readings, rounded, table
from plantpulse.sources.air_cooled import prepare_air_cooled
from plantpulse.sources.historian import clean_table, keep_first, modeling_table, tag_dimension

# A reading as the acquisition system might write it, by event type.
_TEXT_SQL = """CASE event_type WHEN 'error' THEN ' Bad ' WHEN 'signup' THEN CAST(value AS VARCHAR) || 'd'
  ELSE ' ' || CAST(value AS VARCHAR) END"""


def _raw(spark, sf):
    text = (
        F.when(F.col("event_type") == "error", F.lit(" Bad "))
        .when(F.col("event_type") == "signup", F.concat(F.col("value").cast("string"), F.lit("d")))
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    )
    return table(spark, sf, "events").select(
        F.date_trunc("minute", "ts").cast("string").alias(" Time "),
        F.col("event_id").alias("seq"),
        text.alias("tag"),
        text.alias("tag.1"),
        F.lit("Configure").alias("sin_datos"),
    )


def clean_tags(spark, sf):
    cleaned = clean_table(_raw(spark, sf))
    return cleaned.select(naive("Time").alias("Time"), "seq", "tag")


def clean_serial_time(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    raw = table(spark, sf, "events").select(
        (micros / F.lit(86400000000.0) + 25569).alias("Time"),
        F.col("event_id").alias("seq"), "value",
    )
    return clean_table(raw).select(naive("Time").alias("Time"), "seq", "value")


def cleaned_columns(spark, sf):
    """Which columns survive: copies and empty columns do not."""
    cleaned = clean_table(_raw(spark, sf))
    counts = cleaned.agg(*[F.count(c).alias(c) for c in cleaned.columns])
    return counts.unpivot([], cleaned.columns, "columna", "valores")


def dedup_first(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return keep_first(orders, ["o_custkey", "o_orderdate"], "o_orderkey")


def quality(spark, sf):
    rd = readings(spark, sf)
    report = quality_report(rd, rd.count(), "Time", "seq", "value")
    return rounded(report.withColumns({"inicio": naive("inicio"), "fin": naive("fin")}), 3)


def regime_filter(spark, sf):
    cfg = READINGS.with_(min_load=20.0, target_range=(1.0, 120.0))
    kept = operating_rows(readings(spark, sf), cfg)
    return kept.select(naive("Time").alias("Time"), "seq", "value", "cold", "load")


def _wind(spark, sf):
    """Direction by hour of the day; the hours past the sixteenth have none."""
    points = F.array(*[F.lit(p) for p in COMPASS_POINTS])
    point = F.try_element_at(points, (F.hour("ts") + 1).cast("int"))
    events = table(spark, sf, "events")
    return events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"),
        F.col("event_id").alias("seq"),
        F.coalesce(point, F.lit("---")).alias("Wind_dir"),
        (F.col("value") / 100).cast("string").alias("CF"),
        F.col("value").cast("string").alias("TV_BP_Pout"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("T_ambient"),
        F.col("user_id").cast("string").alias("Wind_speed"),
        F.col("user_id").cast("string").alias("BP_Flow"),
        F.col("value").cast("string").alias("TV_BP_Tout"),
    )


def compass_encode(spark, sf):
    wind = _wind(spark, sf).withColumn("grados", compass_degrees(F.col("Wind_dir")))
    text = F.when(~is_missing_direction(F.col("Wind_dir")), F.col("Wind_dir"))
    angle = F.radians("grados")
    grouped = wind.groupBy(text.alias("direccion"), "grados").agg(F.count("*").alias("n"))
    return rounded(
        grouped.withColumn("seno", F.sin(angle)).withColumn("coseno", F.cos(angle))
    )


def prepared_air_cooled(spark, sf):
    p = prepare_air_cooled(_wind(spark, sf), rated_mw=300.0)
    return rounded(p.select(
        naive("Time").alias("Time"), "seq", "vacio", "potencia_mw", "temp_ambiente", "viento",
        "viento_sin", "viento_cos", "direccion",
    ))


def terminal_diff(spark, sf):
    li = table(spark, sf, "lineitem")
    diff = terminal_difference(li, "l_extendedprice", "l_quantity")
    absent = terminal_difference(li, "no_such_tag", "l_quantity")
    return li.select("l_returnflag", diff.alias("ttd"), absent.alias("sin_par")).groupBy("l_returnflag").agg(
        F.count("ttd").alias("n"),
        F.round(F.min("ttd"), 6).alias("ttd_min"),
        F.round(F.max("ttd"), 6).alias("ttd_max"),
        F.count("sin_par").alias("n_sin_par"),
    )


def unit_convert(spark, sf):
    ev = table(spark, sf, "events")
    g = ev.groupBy("event_type").agg(F.max("value").alias("nivel"), F.min("value").alias("piso"))
    return rounded(g.select(
        "event_type", "nivel",
        (F.col("nivel") * INHG_TO_MBAR).alias("mbar"),
        safe_ratio(F.col("piso"), F.col("nivel")).alias("razon"),
        safe_ratio(F.col("nivel"), F.lit(0.0)).alias("razon_cero"),
    ))


def formatted_levels(spark, sf):
    ev = table(spark, sf, "events")
    g = ev.groupBy("event_type").agg(
        F.max("value").alias("v"), F.min("ts").alias("t"), F.count("*").alias("n")
    )
    missing = F.when(F.col("event_type") != "error", F.col("v"))
    return g.select(
        "event_type", formatted(missing, 3).alias("texto"),
        date_prefix(F.col("t")).alias("dia"), thousands(F.col("n")).alias("filas"),
    )


def tag_join(spark, sf):
    """Events in long tag form against the tag dimension (fixed small table)."""
    tags = [t[0] for t in TAGS]
    slot = (F.regexp_extract("props", "([0-9]+)", 1).cast("int") + 1)
    long = table(spark, sf, "events").select(
        F.coalesce(F.try_element_at(F.array(*[F.lit(t) for t in tags]), slot), F.lit("?")).alias("tag"), "value"
    )
    dim = F.broadcast(tag_dimension(spark))
    return long.join(dim, "tag", "left").groupBy("role").agg(
        F.count("*").alias("n"), F.count("alias").alias("con_alias")
    )


def modeling_projection(spark, sf):
    """Raw tags onto model columns."""
    rd = readings(spark, sf)
    wanted = {t[0]: F.col("load") for t in TAGS if t[3] == "driver"}
    raw = rd.select(
        "Time", "seq", F.col("value").alias("FNX:S1_EV_P.PV"), F.col("cold").alias("FNX:10TI3005.PV"),
        *[c.alias(t) for t, c in wanted.items()],
    )
    m = modeling_table(raw, "Time", "FNX:S1_EV_P.PV")
    return m.select(naive("Time").alias("Time"), "vacio", "temp_agua_mar", "potencia_tv", "temp_condensador")


_POINTS_SQL = "[" + ", ".join(f"'{p}'" for p in COMPASS_POINTS) + "]"
_WIND_SQL = f"""wind AS (
  SELECT ts, event_id, value, user_id, props, hour(ts) AS h,
         CASE WHEN hour(ts) < 16 THEN ({_POINTS_SQL})[hour(ts) + 1] END AS direccion,
         CASE WHEN hour(ts) < 16 THEN hour(ts) * 22.5::DOUBLE END AS grados
  FROM events)"""

_TAGS_SQL = ", ".join(
    f"({i}, {'NULL' if role is None else repr(role)}, {'NULL' if alias is None else repr(alias)})"
    for i, (_, _, alias, role) in enumerate(TAGS)
)

QUERIES = {
    "clean_tags": clean_tags,
    "clean_serial_time": clean_serial_time,
    "cleaned_columns": cleaned_columns,
    "dedup_first": dedup_first,
    "quality_report": quality,
    "regime_filter": regime_filter,
    "compass_encode": compass_encode,
    "rated_power": prepared_air_cooled,
    "terminal_diff": terminal_diff,
    "unit_convert": unit_convert,
    "formatted_levels": formatted_levels,
    "tag_dimension": tag_join,
    "modeling_table": modeling_projection,
}

_CLEAN_SQL = f"""WITH raw AS (
  SELECT date_trunc('minute', ts) AS t, event_id AS seq, {_TEXT_SQL} AS txt FROM events),
typed AS (
  SELECT t, seq, CASE WHEN lower(trim(txt)) NOT IN ('configure', 'bad', 'tag not found', 'nan', 'none', '')
     AND regexp_matches(trim(txt), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')
     THEN TRY_CAST(trim(txt) AS DOUBLE) END AS tag FROM raw),
kept AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY seq) AS r FROM typed)"""

SQL = {
    "clean_tags": f"""{_CLEAN_SQL}
SELECT t AS "Time", seq, tag FROM kept WHERE r = 1""",
    "clean_serial_time": """WITH raw AS (
  SELECT epoch_us(ts) / 86400000000.0::DOUBLE + 25569 AS d, event_id AS seq, value FROM events),
typed AS (SELECT CAST(round((d - 25569) * 86400000000) AS BIGINT) AS us, seq, value FROM raw),
kept AS (SELECT *, row_number() OVER (PARTITION BY us ORDER BY seq) AS r FROM typed)
SELECT make_timestamp(us) AS "Time", seq, value FROM kept WHERE r = 1""",
    "cleaned_columns": f"""{_CLEAN_SQL}
SELECT 'Time' AS columna, count(t) AS valores FROM kept WHERE r = 1
UNION ALL SELECT 'seq', count(seq) FROM kept WHERE r = 1
UNION ALL SELECT 'tag', count(tag) FROM kept WHERE r = 1""",
    "dedup_first": """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders)
WHERE r = 1""",
    "quality_report": f"""WITH {RD_SQL}, st AS (
  SELECT *, (epoch_us("Time") - epoch_us(lag("Time") OVER (ORDER BY "Time", seq))) / 60000000.0 AS step FROM rd)
SELECT count(*) AS filas_crudas, count(*) AS filas_limpias, min("Time") AS inicio, max("Time") AS fin,
       count(*) FILTER (value IS NULL) AS vacio_nulos, round(median(step), 3) AS paso_mediano_min FROM st""",
    "regime_filter": f"""WITH {RD_SQL}
SELECT "Time", seq, value, cold, load FROM rd
WHERE load >= 20 AND value BETWEEN 1 AND 120 AND cold IS NOT NULL AND load IS NOT NULL AND hora IS NOT NULL""",
    "compass_encode": f"""WITH {_WIND_SQL}
SELECT direccion, grados, count(*) AS n, round(sin(radians(grados)), 6) AS seno,
       round(cos(radians(grados)), 6) AS coseno FROM wind GROUP BY 1, 2""",
    "rated_power": f"""WITH {_WIND_SQL}
SELECT ts AS "Time", event_id AS seq, value AS vacio, round(value / 100 * 300, 6) AS potencia_mw,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS temp_ambiente,
       CAST(user_id AS DOUBLE) AS viento, round(sin(radians(grados)), 6) AS viento_sin,
       round(cos(radians(grados)), 6) AS viento_cos, direccion
FROM wind WHERE direccion IS NOT NULL AND value IS NOT NULL""",
    "terminal_diff": """SELECT l_returnflag, count(l_extendedprice - l_quantity) AS n,
  round(min(l_extendedprice - l_quantity), 6) AS ttd_min, round(max(l_extendedprice - l_quantity), 6) AS ttd_max,
  CAST(0 AS BIGINT) AS n_sin_par FROM lineitem GROUP BY 1""",
    "unit_convert": """SELECT event_type, max(value) AS nivel, round(max(value) * 33.8639::DOUBLE, 6) AS mbar,
  round(min(value) / max(value), 6) AS razon, CAST(NULL AS DOUBLE) AS razon_cero FROM events GROUP BY 1""",
    "formatted_levels": """SELECT event_type,
  CASE WHEN event_type = 'error' THEN 's/d' ELSE printf('%.3f', max(value)) END AS texto,
  strftime(min(ts), '%Y-%m-%d') AS dia, format('{:,}', count(*)) AS filas FROM events GROUP BY event_type""",
    "tag_dimension": f"""WITH dim(i, role, alias) AS (VALUES {_TAGS_SQL}),
long AS (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS i FROM events)
SELECT role, count(*) AS n, count(alias) AS con_alias FROM long LEFT JOIN dim USING (i) GROUP BY role""",
    "modeling_table": f"""WITH {RD_SQL}
SELECT "Time", value AS vacio, load AS temp_agua_mar, load AS potencia_tv, cold AS temp_condensador FROM rd""",
}
