"""Sources and sinks: the supplied tables written out, read back and worked on."""

from __future__ import annotations

import math

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from plantpulse.config import TAGS
from plantpulse.models.catalog import FEATURES, assemble
from plantpulse.operators.regime import level_stats
from plantpulse.operators.splits import chronological_split
from plantpulse.plans.scoring import read_batch, score_file, score_records, validate_records
from plantpulse.registry import scores
from plantpulse.registry.serving import BUNDLE, FIELDS, OBSERVED, SCORED_ALL_SQL, _REC_SQL, _records
from plantpulse.registry.views import RD_SQL, TRAIN, VAL, readings, rounded, split_readings, split_sql, table
from plantpulse.session import scratch_path
from plantpulse.sources.bundle import ScoringBundle, load_bundle, save_bundle
from plantpulse.sources.historian import (
    clean_table, last_modified, load_historian, read_csv, split_malformed,
)
from plantpulse.sources.sinks import read_records, read_summary, write_csv, write_json, write_summary

_TARGET = next(tag for tag, _, _, role in TAGS if role == "target")
_DRIVERS = [tag for tag, _, _, role in TAGS if role == "driver"]


def _text(column: str):
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def csv_study_split(spark, sf):
    """An extract in CSV: read as text, cleaned, and cut in time."""
    path = scratch_path(spark, "extract")
    write_csv(readings(spark, sf).select(_text("Time").alias(" Time "), "value", "cold", "load"), path)
    clean = clean_table(read_csv(spark, path), "Time")
    split = chronological_split(clean, ["Time", "seq"], TRAIN, VAL)
    return split.groupBy("particion").agg(
        F.count("*").alias("n"), F.min("Time").cast("timestamp_ntz").alias("inicio"),
        F.max("Time").cast("timestamp_ntz").alias("fin"), F.count("value").alias("valores"),
    )


def csv_quarantine(spark, sf):
    """Lines with a field too many or too few are set aside whole."""
    path = scratch_path(spark, "lines")
    bad = F.col("event_id") % 50
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    broken = F.when(bad == 7, F.concat(line, F.lit(",extra"))).when(bad == 9, F.col("event_id").cast("string"))
    table(spark, sf, "events").select(F.coalesce(broken, line).alias("value")).write.text(path)
    rows = read_csv(spark, path, ingest_order=False, names=["event_id", "user_id", "event_type"], corrupt="_line")
    good, aside = split_malformed(rows, "_line")
    return good.select(F.concat_ws(",", "event_id", "user_id", "event_type").alias("linea"), F.lit(True).alias("entera")).unionAll(
        aside.select("line", F.lit(False))
    )


def cleaned_copy(spark, sf):
    """The cleaned copy of an extract: built by the first load, read by the second."""
    extract, copy = scratch_path(spark, "historian"), scratch_path(spark, "copy")
    rd = readings(spark, sf)
    columns = [F.col("value").alias(_TARGET), *[(F.col("load") + i).alias(t) for i, t in enumerate(_DRIVERS)]]
    write_csv(rd.select(_text("Time").alias("Time"), *columns), extract)
    rows, stamps = [], []
    for step in (1, 2):
        loaded = load_historian(spark, extract, copy, "Time", _TARGET)
        stamps.append(last_modified(spark, copy))
        n, target = loaded.agg(F.count("*"), F.count("vacio")).first()
        rows.append((step, n, target, len(loaded.columns), stamps[-1] == stamps[0]))
    return spark.createDataFrame(rows, "carga int, n long, valores long, columnas int, misma_copia boolean")


def json_snapshots(spark, sf):
    path = scratch_path(spark, "snapshots")
    write_json(_records(table(spark, sf, "events")).select("event_id", "k", "user_id", "value"), path)
    return read_records(spark, path, "event_id long, k double, user_id double, value double", multi_line=False)


def summary_document(spark, sf):
    """A nested summary written as one JSON document; what is not finite comes back as null."""
    path = scratch_path(spark, "summary")
    rd = readings(spark, sf)
    levels = level_stats(rd, "value").first().asDict()
    write_summary(spark, {
        "filas": rd.count(), "niveles": {k: levels[k] for k in ("min", "mediana", "max")},
        "lista": [1.5, math.inf, -math.inf, math.nan],
    }, path)
    back = read_summary(spark, path)
    rows = [("filas", float(back["filas"])), *back["niveles"].items(),
            *((f"lista_{i}", v) for i, v in enumerate(back["lista"]))]
    return rounded(spark.createDataFrame(rows, "clave string, valor double"))


def metric_table_csv(spark, sf):
    path = scratch_path(spark, "metrics")
    found = scores.ols_scores(spark, sf)
    write_csv(found, path)
    return spark.read.schema(found.schema).option("header", True).csv(path)


def batch_csv_scores(spark, sf):
    """Records from CSV through the scorer to CSV."""
    records, out = f"{scratch_path(spark, 'records')}.csv", scratch_path(spark, "scored")
    write_csv(_records(table(spark, sf, "events")).select("user_id", "k", "value"), records)
    scored = score_file(spark, BUNDLE, records, out, FIELDS, OBSERVED[0])
    return spark.read.schema(scored.schema).option("header", True).csv(out)


# What happens to the file of each event type: what it lacks, and the ending of its name.
_FILE_FAULTS = {
    "view": (None, ".csv"), "signup": ("value", ".csv"), "click": ("k", ".csv"), "error": ("rows", ".csv"),
    "purchase": (None, ".txt"),
}
_REFUSED = {"click": "columna", "error": "vacio", "purchase": "tipo"}


def file_checks(spark, sf):
    """One batch file per event type: taken with its rows, or refused for what it lacks.

    Observed values are optional; required columns, rows and the file type are not.
    """
    records = _records(table(spark, sf, "events"))
    rows = []
    for kind, (lacks, ending) in _FILE_FAULTS.items():
        path = f"{scratch_path(spark, kind)}{ending}"
        mine = records.filter(F.col("event_type") == kind).select("user_id", "k", "value")
        write_csv(mine.limit(0) if lacks == "rows" else mine.drop(lacks or ""), path)
        try:
            batch = read_batch(spark, path, FIELDS, OBSERVED[0])
            rows.append((kind, True, None, *batch.agg(F.count("*"), F.count(OBSERVED[0])).first()))
        except KeyError:
            rows.append((kind, False, "columna", None, None))
        except ValueError:
            rows.append((kind, False, "vacio" if ending == ".csv" else "tipo", None, None))
    return spark.createDataFrame(rows, "archivo string, aceptado boolean, motivo string, filas long, observados long")


def bundle_scores(spark, sf):
    """A tree bundle saved and loaded scores every valid record as it did in memory."""
    train = assemble(split_readings(spark, sf).filter("particion = 'train'"), ["cold", "load"])
    tree = DecisionTreeRegressor(featuresCol=FEATURES, labelCol="value", maxDepth=4, seed=42).fit(train)
    bundle = ScoringBundle(tree, BUNDLE.baseline, "arbol", ("cold", "load"), BUNDLE.alert, BUNDLE.critical)
    path = scratch_path(spark, "bundle")
    save_bundle(spark, bundle, path)
    records, _ = validate_records(_records(table(spark, sf, "events")), FIELDS, OBSERVED)
    kept = score_records(records, bundle, FIELDS, OBSERVED[0], ["event_id"])
    loaded = score_records(records, load_bundle(spark, path), FIELDS, OBSERVED[0], ["event_id"])
    pairs = kept.select("event_id", F.struct(*kept.columns).alias("a")).join(
        loaded.select("event_id", F.struct(*loaded.columns).alias("b")), "event_id", "full"
    )
    return pairs.agg(
        F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("diferencias"),
        F.count_if(F.col("b.anomalia")).alias("anomalias"),
    )


QUERIES = {
    "csv_study_split": csv_study_split,
    "csv_quarantine": csv_quarantine,
    "cleaned_copy": cleaned_copy,
    "json_snapshots": json_snapshots,
    "summary_document": summary_document,
    "metric_table_csv": metric_table_csv,
    "batch_csv_scores": batch_csv_scores,
    "file_checks": file_checks,
    "bundle_scores": bundle_scores,
}

SQL = {
    "file_checks": f"""WITH {_REC_SQL},
f(archivo, motivo) AS (VALUES {", ".join(f"('{k}', " + (f"'{_REFUSED[k]}'" if k in _REFUSED else "NULL") + ")" for k in _FILE_FAULTS)})
SELECT archivo, motivo IS NULL AS aceptado, motivo,
  CASE WHEN motivo IS NULL THEN (SELECT count(*) FROM rec WHERE event_type = archivo) END AS filas,
  CASE WHEN motivo IS NULL THEN (SELECT count(value) FROM rec WHERE event_type = archivo AND archivo <> 'signup') END AS observados
FROM f""",
    "csv_study_split": f"""WITH d AS (SELECT DISTINCT ts AS "Time" FROM events), {split_sql('d', '"Time"')}
SELECT particion, count(*) AS n, min("Time") AS inicio, max("Time") AS fin, count(*) AS valores FROM sp GROUP BY 1""",
    "csv_quarantine": """SELECT CASE event_id % 50 WHEN 7 THEN event_id || ',' || user_id || ',' || event_type || ',extra'
  WHEN 9 THEN CAST(event_id AS VARCHAR) ELSE event_id || ',' || user_id || ',' || event_type END AS linea,
  event_id % 50 NOT IN (7, 9) AS entera FROM events""",
    "cleaned_copy": f"""SELECT unnest([1, 2]) AS carga, n, n AS valores, {len(_DRIVERS) + 3} AS columnas, true AS misma_copia
FROM (SELECT count(DISTINCT ts) AS n FROM events)""",
    "json_snapshots": f"WITH {_REC_SQL} SELECT event_id, k, user_id, value FROM rec",
    "summary_document": f"""WITH {RD_SQL}
SELECT unnest(['filas', 'min', 'mediana', 'max', 'lista_0', 'lista_1', 'lista_2', 'lista_3']) AS clave,
  unnest([round(n, 6), round(a, 6), round(m, 6), round(b, 6), 1.5, NULL, NULL, NULL]) AS valor
FROM (SELECT CAST(count(*) AS DOUBLE) AS n, min(value) AS a, median(value) AS m, max(value) AS b FROM rd)""",
    "metric_table_csv": scores.SQL["ols_scores"],
    "batch_csv_scores": SCORED_ALL_SQL,
    "bundle_scores": f"""WITH {_REC_SQL}
SELECT count(*) AS n, 0::BIGINT AS diferencias, count(*) FILTER (value - b > 100) AS anomalias FROM sc""",
}
