"""Splits, folds, samples, lags and horizons."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.operators.metrics import regression_scores
from plantpulse.operators.ordered import positions
from plantpulse.operators.regime import last_rows, split_profile, step_minutes
from plantpulse.operators.splits import (
    chronological_split, curve_sizes, expanding_folds, row_prefixes, systematic_sample,
)
from plantpulse.operators.windows import forecast_columns
from plantpulse.plans.forecast import naive_predictions, ready_table
from plantpulse.registry.views import (
    HOURLY, HOURLY_SQL, PLANT, PLANT_SQL, RD_SQL, TRAIN, VAL, hourly, naive, plant, readings, rounded,
    rounded_scores, scores_sql, split_sql, table,
)
from plantpulse.session import written
from plantpulse.streaming.jobs import resample

_ORDER = ["o_orderdate", "o_orderkey"]


def _split_orders(spark, sf):
    orders = table(spark, sf, "orders").select(*_ORDER, "o_totalprice", "o_custkey")
    return chronological_split(orders, _ORDER, TRAIN, VAL)


def split_counts(spark, sf):
    return _split_orders(spark, sf).groupBy("particion").agg(
        F.count("*").alias("n"), F.min("o_orderdate").alias("inicio"), F.max("o_orderdate").alias("fin")
    )


def profile_of_split(spark, sf):
    return rounded(split_profile(_split_orders(spark, sf), "o_orderdate", ["o_totalprice", "o_custkey"]))


def split_rows(spark, sf):
    return _split_orders(spark, sf).select("o_orderkey", "particion")


def hourly_grid(spark, sf):
    rd = readings(spark, sf)
    grid = resample(rd, "Time", "1 hour", ["unit"], [
        (F.round(F.sum("value"), 2) / F.count("*")).alias("y"), F.count("*").alias("n"),
    ])
    return rounded(grid.select(naive("Time").alias("Time"), "unit", "y", "n"))


def lag_features(spark, sf):
    cfg = HOURLY
    seen = forecast_columns(
        hourly(spark, sf), "Time", "unit", "y", list(cfg.lags), cfg.horizon, cfg.step_minutes, "unit"
    )
    kept = [c for k in cfg.lags for c in (f"y_lag_{k}", f"ok_lag_{k}")]
    return rounded(seen.select(naive("Time").alias("Time"), "unit", "y_ahora", *kept, "y_futuro", "ok_futuro"))


def event_lags(spark, sf):
    """Lags on the raw, irregular events of each type."""
    seen = forecast_columns(
        readings(spark, sf), "Time", "seq", "value", [1, 2], 1, 20.0, "unit"
    )
    return seen.select("seq", "value_lag_1", "ok_lag_1", "value_lag_2", "ok_lag_2", "value_futuro", "ok_futuro")


def _ready(spark, sf):
    ready = ready_table(hourly(spark, sf), HOURLY)
    return ready


def forecast_ready(spark, sf):
    return rounded(_ready(spark, sf).select(
        naive("Time").alias("Time"), "unit", "y_ahora", "y_futuro", "y_lag_1", "y_lag_24", "cold", "load"
    ))


def _naive_scores(spark, sf, model):
    ready = written(_ready(spark, sf), "ready")
    split = chronological_split(ready, ["Time", "unit"], TRAIN, VAL).filter("particion <> 'train'")
    columns = naive_predictions(ready, HOURLY)
    return rounded(regression_scores(split, "y_futuro", {model: columns[model]}))


def persistence_scores(spark, sf):
    return _naive_scores(spark, sf, "persistencia")


def daily_persistence_scores(spark, sf):
    return _naive_scores(spark, sf, "persistencia_diaria")


def median_step(spark, sf):
    steps = step_minutes(readings(spark, sf).select("Time", "seq", "unit"), "Time", "seq", "unit")
    return rounded(steps.select("seq", "unit", "step_min"), 9)


def sample_evenly(spark, sf):
    orders = table(spark, sf, "orders").select(*_ORDER)
    return systematic_sample(orders, _ORDER, 6000)


def row_positions(spark, sf):
    orders = table(spark, sf, "orders").select(*_ORDER)
    return positions(orders, _ORDER).select("o_orderkey", "pos")


def folds(spark, sf):
    orders = table(spark, sf, "orders").select(*_ORDER)
    out = None
    for i, (train, test) in enumerate(expanding_folds(orders, _ORDER)):
        def facts(df, part):
            return df.agg(
                F.count("*").alias("n"), F.min(_ORDER[0]).alias("inicio"), F.max(_ORDER[0]).alias("fin")
            ).select(F.lit(i).alias("fold"), F.lit(part).alias("parte"), "n", "inicio", "fin")
        both = facts(train, "train").unionByName(facts(test, "test"))
        out = both if out is None else out.unionByName(both)
    return out


def prefix_sizes(spark, sf):
    orders = table(spark, sf, "orders").select(*_ORDER)
    total = orders.count()
    sizes = curve_sizes(total)
    first = row_prefixes(orders, _ORDER, sizes, total)
    tests = [F.count_if(first[s]).alias(str(i)) for i, s in enumerate(sizes)]
    return orders.agg(*tests).unpivot([], [str(i) for i in range(len(sizes))], "paso", "muestras")


def preview_tail(spark, sf):
    return rounded(last_rows(plant(spark, sf).select(naive("Time").alias("Time"), "y"), ["Time"], 200))


_LAGS = HOURLY.lags
_LAG_SQL = HOURLY_SQL + ", w AS (SELECT *, " + ", ".join(
    f"""lag(y, {k}) OVER p AS l{k},
  coalesce((epoch_us("Time") - epoch_us(lag("Time", {k}) OVER p)) / 60000000.0
    BETWEEN {k * 60 * 0.75} AND {k * 60 * 1.25}, false) AS ok{k}""" for k in _LAGS
) + """, lead(y, 4) OVER p AS f, coalesce((epoch_us(lead("Time", 4) OVER p) - epoch_us("Time")) / 60000000.0
    BETWEEN 180 AND 300, false) AS okf FROM hourly WINDOW p AS (PARTITION BY unit ORDER BY "Time"))"""
_READY_SQL = _LAG_SQL + f""", ready AS (
  SELECT "Time", unit, y AS y_ahora, f AS y_futuro, {", ".join(f"l{k} AS y_lag_{k}" for k in _LAGS)}, cold, load
  FROM w WHERE {" AND ".join(f"ok{k}" for k in _LAGS)} AND okf AND f IS NOT NULL)"""
NAIVE_READY_SQL = _READY_SQL
_NAIVE_SQL = f"WITH {_READY_SQL}, {split_sql('ready', '\"Time\", unit')}\n"
_SPLIT_ORDERS = f"WITH {split_sql('orders', 'o_orderdate, o_orderkey')}\n"
_POS = "pos AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"
_FOLD = """SELECT {i} AS fold, '{part}' AS parte, count(*) AS n, min(o_orderdate) AS inicio, max(o_orderdate) AS fin
  FROM pos WHERE {rule}"""


def _event_lag(k: int) -> str:
    return f"""CASE WHEN coalesce((epoch_us("Time") - epoch_us(lag("Time", {k}) OVER p)) / 60000000.0
    BETWEEN {15.0 * k} AND {25.0 * k}, false) THEN lag(value, {k}) OVER p END AS value_lag_{k},
  coalesce((epoch_us("Time") - epoch_us(lag("Time", {k}) OVER p)) / 60000000.0
    BETWEEN {15.0 * k} AND {25.0 * k}, false) AS ok_lag_{k}"""


QUERIES = {
    "split_counts": split_counts,
    "split_profile": profile_of_split,
    "split_rows": split_rows,
    "hourly_resample": hourly_grid,
    "lag_features": lag_features,
    "event_lags": event_lags,
    "forecast_ready": forecast_ready,
    "persistence_scores": persistence_scores,
    "daily_persistence_scores": daily_persistence_scores,
    "step_minutes": median_step,
    "systematic_sample": sample_evenly,
    "row_positions": row_positions,
    "expanding_folds": folds,
    "curve_sizes": prefix_sizes,
    "preview_tail": preview_tail,
}

SQL = {
    "split_counts": _SPLIT_ORDERS + """SELECT particion, count(*) AS n, min(o_orderdate) AS inicio,
  max(o_orderdate) AS fin FROM sp GROUP BY 1""",
    "split_profile": _SPLIT_ORDERS + """SELECT particion, count(*) AS n, min(o_orderdate) AS inicio,
  max(o_orderdate) AS fin, round(median(o_totalprice), 6) AS o_totalprice,
  round(median(CAST(o_custkey AS DOUBLE)), 6) AS o_custkey FROM sp GROUP BY 1""",
    "split_rows": _SPLIT_ORDERS + "SELECT o_orderkey, particion FROM sp",
    "hourly_resample": f"""WITH {HOURLY_SQL}
SELECT "Time", unit, round(y, 6) AS y, CAST(load AS BIGINT) AS n FROM hourly""",
    "lag_features": f"WITH {_LAG_SQL}\n" + 'SELECT "Time", unit, round(y, 6) AS y_ahora, ' + ", ".join(
        f"CASE WHEN ok{k} THEN round(l{k}, 6) END AS y_lag_{k}, ok{k} AS ok_lag_{k}" for k in _LAGS
    ) + ", CASE WHEN okf THEN round(f, 6) END AS y_futuro, okf AS ok_futuro FROM w",
    "event_lags": f"""WITH {RD_SQL}
SELECT seq, {_event_lag(1)}, {_event_lag(2)},
  CASE WHEN coalesce((epoch_us(lead("Time") OVER p) - epoch_us("Time")) / 60000000.0 BETWEEN 15 AND 25, false)
    THEN lead(value) OVER p END AS value_futuro,
  coalesce((epoch_us(lead("Time") OVER p) - epoch_us("Time")) / 60000000.0 BETWEEN 15 AND 25, false) AS ok_futuro
FROM rd WINDOW p AS (PARTITION BY unit ORDER BY "Time", seq)""",
    "forecast_ready": f"""WITH {_READY_SQL}
SELECT "Time", unit, round(y_ahora, 6) AS y_ahora, round(y_futuro, 6) AS y_futuro, round(y_lag_1, 6) AS y_lag_1,
  round(y_lag_24, 6) AS y_lag_24, round(cold, 6) AS cold, load FROM ready""",
    "persistence_scores": _NAIVE_SQL + rounded_scores(
        scores_sql("y_futuro", {"persistencia": "y_ahora"}, "sp", "particion <> 'train'")
    ),
    "daily_persistence_scores": _NAIVE_SQL + rounded_scores(
        scores_sql("y_futuro", {"persistencia_diaria": "y_lag_24"}, "sp", "particion <> 'train'")
    ),
    "step_minutes": f"""WITH {RD_SQL}
SELECT seq, unit, round((epoch_us("Time") - epoch_us(lag("Time") OVER (PARTITION BY unit ORDER BY "Time", seq)))
  / 60000000.0, 9) AS step_min FROM rd""",
    "systematic_sample": f"""WITH {_POS}, m AS (SELECT count(*) AS n, least(6000, count(*)) AS m FROM orders),
want AS (SELECT CASE WHEN i = m - 1 THEN n - 1
                ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / CAST(m - 1 AS DOUBLE))) AS BIGINT) END AS pos
         FROM m, range(6000) AS r(i) WHERE i < m)
SELECT o_orderdate, o_orderkey FROM pos WHERE pos IN (SELECT pos FROM want)""",
    "row_positions": f"WITH {_POS} SELECT o_orderkey, pos FROM pos",
    "expanding_folds": f"WITH {_POS}\n" + "\nUNION ALL ".join(
        _FOLD.format(i=i, part=part, rule=rule)
        for i in range(3)
        for part, rule in (
            ("train", f"pos < n - {3 - i} * (n // 4)"),
            ("test", f"pos >= n - {3 - i} * (n // 4) AND pos < n - {2 - i} * (n // 4)"),
        )
    ),
    "curve_sizes": """WITH t AS (SELECT count(*) - 3 * (count(*) // 4) AS first FROM orders)
SELECT CAST(i AS VARCHAR) AS paso,
  CAST(floor(first * (CAST(0.2 AS DOUBLE) + i * (CAST(0.8 AS DOUBLE) / 4))) AS BIGINT) AS muestras
FROM t, range(5) AS r(i)""",
    "preview_tail": f"""WITH {PLANT_SQL}
SELECT "Time", round(y, 6) AS y FROM plant ORDER BY "Time" DESC LIMIT 200""",
}
