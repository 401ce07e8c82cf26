"""Levels, drift, rank tests, collinearity, histograms, unit root."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.functions.numbers import significant
from plantpulse.operators.collinearity import variance_inflation
from plantpulse.operators.drift import population_stability
from plantpulse.operators.ordered import column_quantiles, prefix_sums, quantiles
from plantpulse.operators.ranktest import mann_whitney, spearman_matrix
from plantpulse.operators.regime import (
    histogram, level_stats, median_by_category, shared_limits,
)
from plantpulse.operators.sketches import (
    daily_sketches, merged_quantiles, rank_bound, rank_errors, store_sketches, stored_sketches,
)
from plantpulse.operators.stationarity import adf
from plantpulse.registry.views import (
    LABELLED_SQL, RD_SQL, READINGS, labelled_readings, readings, rounded, table,
)
from plantpulse.session import scratch_path

_CUT = "1998-01-01"
_PSI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TRIO = ["l_quantity", "l_extendedprice", "l_discount"]


def levels(spark, sf):
    return rounded(level_stats(readings(spark, sf), "value", ["unit"]))


def overall_level(spark, sf):
    return rounded(level_stats(table(spark, sf, "lineitem"), "l_extendedprice"))


def exact_quantiles(spark, sf):
    q = quantiles(table(spark, sf, "lineitem"), _PSI, [0.05, 0.5, 0.95], ["l_returnflag"])
    return rounded(q.select(
        "l_returnflag", "variable", "n",
        *[F.col("q")[i].alias(name) for i, name in enumerate(("p05", "p50", "p95"))],
    ))


def unpivot_profile(spark, sf):
    stats = levels(spark, sf)
    return stats.unpivot("unit", ["media", "mediana", "p95"], "medida", "valor")


def psi_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_shipdate", *_PSI)
    cut = F.to_timestamp_ntz(F.lit(_CUT))
    # Later prices are scaled so that one feature really drifts.
    later = li.filter(F.col("l_shipdate") >= cut).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.5)
    return rounded(population_stability(li.filter(F.col("l_shipdate") < cut), later, _PSI))


def document_test(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    both = table(spark, sf, "labels").join(docs, "doc_id").withColumn(
        "grupo", F.when(F.col("quality") == 1, "critico").otherwise("normal")
    )
    return rounded(mann_whitney(both, ["n_chars"], "grupo", "normal", "critico").drop("p_valor"))


def contrast_tests(spark, sf):
    held = labelled_readings(spark, sf).filter("particion = 'test'")
    tests = mann_whitney(held, ["value", "cold", "load", "hora"], "clase", "normal", "critico")
    return rounded(tests.drop("p_valor"))


def contrast_p_values(spark, sf):
    held = labelled_readings(spark, sf).filter("particion = 'test'")
    tests = mann_whitney(held, ["cold", "load", "hora"], "clase", "normal", "critico")
    return tests.select(
        "variable", F.round("p_valor", 6).alias("p_valor"), significant(F.col("p_valor")).alias("significativo")
    )


def vif(spark, sf):
    return rounded(variance_inflation(table(spark, sf, "lineitem"), _TRIO))


def spearman(spark, sf):
    return rounded(spearman_matrix(table(spark, sf, "lineitem"), _TRIO))


def residual_histogram(spark, sf):
    held = labelled_readings(spark, sf).filter("particion = 'test'")
    return histogram(held.withColumn("r", F.round("residual_base", 6)), "r").select("bin", "n")


def limits(spark, sf):
    held = labelled_readings(spark, sf).filter("particion = 'test'")
    return rounded(shared_limits(held, "value", "vacio_base"))


def by_category(spark, sf):
    return rounded(median_by_category(readings(spark, sf), "unit", "value"))


_MARKS = [READINGS.alert_quantile, READINGS.critical_quantile]


def threshold_sketches(spark, sf):
    """Residual limits of every unit from daily sketches that arrive in two parts.

    The day between the parts arrives twice.  ``dentro`` says whether the true rank of the
    merged limit, counted over all rows, is within the bound that the sketch states.
    """
    rows = labelled_readings(spark, sf).filter("particion = 'train'").select("unit", "Time", "residual_base")
    sketches = daily_sketches(rows, "residual_base", "Time", ["unit"])
    first, last = rows.agg(F.min(F.to_date("Time")), F.max(F.to_date("Time"))).first()
    middle = F.lit(first + (last - first) / 2)
    place = scratch_path(spark, "sketches")
    store_sketches(sketches.filter(F.col("day") <= middle), place)
    store_sketches(sketches.filter(F.col("day") >= middle), place)
    limits = merged_quantiles(stored_sketches(spark, place), _MARKS, ["unit"])
    errors = rank_errors(rows, "residual_base", limits, _MARKS, ["unit"])
    return errors.join(limits, "unit").select(
        "unit", F.col("days").alias("dias"), "n", "prob", (F.col("error") <= rank_bound()).alias("dentro")
    )


def unit_root(spark, sf):
    return adf(readings(spark, sf), ["Time", "seq"], "value")


def unit_root_lag0(spark, sf):
    return rounded(adf(readings(spark, sf), ["Time", "seq"], "value", lags=0).drop("adf_p_valor"), 5)


def unit_root_lag1(spark, sf):
    """One lagged difference on the running sum of the centred readings, a near unit root."""
    return rounded(adf(_wander(spark, sf), ["Time", "seq"], "x", lags=1), 5)


def unit_root_by_unit(spark, sf):
    """Every unit's readings as a series of its own, at most one lagged difference by AIC."""
    return rounded(adf(readings(spark, sf), ["Time", "seq"], "value", by=["unit"], top=1).drop("adf_p_valor"), 5)


def _wander(spark, sf):
    """Daily running share of large readings: a short, slowly moving series."""
    day = F.date_trunc("day", F.col("Time"))
    days = readings(spark, sf).groupBy(day.alias("Time")).agg(
        F.sum((F.col("value") > 40).cast("long")).alias("c"), F.count("*").alias("t"))
    run = prefix_sums(days, ["Time"], ["c", "t"])
    share = (F.col("before_c") + F.col("c")) / (F.col("before_t") + F.col("t"))
    return run.select("Time", F.lit(0).alias("seq"), share.alias("x"))


def _psi_sql() -> str:
    long = "\n  UNION ALL ".join(
        f"""SELECT '{f}' AS v, l_shipdate < TIMESTAMP '{_CUT}' AS ref,
        {f}{" * CASE WHEN l_shipdate < TIMESTAMP '" + _CUT + "' THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END" if f == "l_extendedprice" else ""} AS x FROM lineitem"""
        for f in _PSI
    )
    probs = "[" + ", ".join(f"CAST({i} AS DOUBLE) / 10" for i in range(11)) + "]"
    return f"""WITH long AS ({long}),
cuts AS (SELECT v, list_sort(list_distinct(quantile_cont(x, {probs}))) AS c FROM long WHERE ref GROUP BY v),
binned AS (
  SELECT long.v, ref, least(len(list_filter(c, lambda e: e <= x)), len(c) - 1) - 1 AS b
  FROM long JOIN cuts ON long.v = cuts.v WHERE x >= c[1] AND x <= c[len(c)]),
frame AS (SELECT v, unnest(range(len(c) - 1)) AS b FROM cuts),
n AS (
  SELECT frame.v, frame.b, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS k
  FROM frame LEFT JOIN binned ON frame.v = binned.v AND frame.b = binned.b GROUP BY 1, 2),
s AS (
  SELECT v, b, greatest(r / sum(r) OVER (PARTITION BY v), 1e-4) AS r,
         greatest(k / greatest(sum(k) OVER (PARTITION BY v), 1), 1e-4) AS k FROM n),
p AS (SELECT v, r / sum(r) OVER (PARTITION BY v) AS r, k / sum(k) OVER (PARTITION BY v) AS k FROM s),
i AS (SELECT v, sum((k - r) * ln(k / r)) AS psi FROM p GROUP BY v)
SELECT v AS variable, round(psi, 6) AS psi,
  CASE WHEN psi < 0.1 THEN 'estable' WHEN psi < 0.25 THEN 'cambio_moderado' ELSE 'drift' END AS banda FROM i"""


def _rank_sql(long: str) -> str:
    """long: rows (variable, g1, x); the first group is g1."""
    return f"""long AS ({long}),
vals AS (SELECT variable, x, count(*) FILTER (g1) AS c1, count(*) AS t FROM long WHERE x IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, sum(t) OVER (PARTITION BY variable ORDER BY x) - t + (t + 1) / 2.0 AS r FROM vals),
s AS (SELECT variable, sum(c1) AS n1, sum(t) AS n, sum(c1 * CAST(r AS DOUBLE)) AS r1,
        CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM rk GROUP BY 1),
md AS (SELECT variable, median(CAST(x AS DOUBLE)) FILTER (g1) AS m1, median(CAST(x AS DOUBLE)) FILTER (NOT g1) AS m2
       FROM long GROUP BY 1)
SELECT s.variable, CAST(n1 AS BIGINT) AS n_normal, CAST(n - n1 AS BIGINT) AS n_critico,
  CASE WHEN least(n1, n - n1) >= 20 THEN round(m1, 6) END AS mediana_normal,
  CASE WHEN least(n1, n - n1) >= 20 THEN round(m2, 6) END AS mediana_critico,
  CASE WHEN least(n1, n - n1) >= 20 THEN round(r1 - n1 * (n1 + 1) / 2.0, 6) END AS estadistico,
  CASE WHEN least(n1, n - n1) >= 20 THEN round(ties, 6) END AS empates
FROM s JOIN md ON md.variable = s.variable"""


def _erfc_sql(x: str) -> str:
    """Complementary error function of a column, by the series of positive terms of erf."""
    series = f"""list_sum([exp(k * ln(4.0) + (2 * k + 1) * ln(abs({x})) + lgamma(k + 1.0) - lgamma(2.0 * k + 2))
      for k in range(250)])"""
    erf = f"(CASE WHEN {x} = 0 THEN 0 ELSE sign({x}) * 2 / sqrt(pi()) * exp(-{x} * {x}) * {series} END)"
    return f"(CASE WHEN {x} > 6 THEN 0.0 WHEN {x} < -6 THEN 2.0 ELSE 1 - {erf} END)"


def _p_values_sql(long: str) -> str:
    head = _rank_sql(long)
    return head[:head.rindex("SELECT s.variable")] + f""", z AS (
  SELECT variable, n1, n - n1 AS n2, n, ties, r1 - n1 * (n1 + 1) / 2.0 AS u FROM s),
x AS (SELECT variable, least(n1, n2) AS least_n,
  (abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))) / sqrt(2.0) AS x FROM z),
p AS (SELECT variable, CASE WHEN least_n >= 20 THEN least(1.0, {_erfc_sql("x")}) END AS p FROM x)
SELECT variable, round(p, 6) AS p_valor, p < 0.05 AS significativo FROM p"""


def _corr_pairs(columns: list[str], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, round(corr(r_{a}, r_{b}), 6) AS rho FROM {source}"
        for a in columns for b in columns
    )


_AVG_RANK = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _TRIO
)
_A, _B, _C = _TRIO

QUERIES = {
    "level_stats": levels,
    "overall_level": overall_level,
    "exact_quantiles": exact_quantiles,
    "unpivot_profile": unpivot_profile,
    "psi_features": psi_features,
    "mann_whitney": document_test,
    "hypothesis_tests": contrast_tests,
    "hypothesis_p_values": contrast_p_values,
    "vif": vif,
    "spearman": spearman,
    "residual_histogram": residual_histogram,
    "obs_pred_limits": limits,
    "median_by_direction": by_category,
    "threshold_sketches": threshold_sketches,
    "adf": unit_root,
    "adf_lag1": unit_root_lag1,
    "adf_by_unit": unit_root_by_unit,
    "dickey_fuller_lag0": unit_root_lag0,
}

_LEVELS = """SELECT unit, round(avg(value), 6) AS media, round(median(value), 6) AS mediana,
  round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM rd GROUP BY 1"""

SQL = {
    "level_stats": f"WITH {RD_SQL} {_LEVELS}",
    "overall_level": """SELECT round(avg(l_extendedprice), 6) AS media, round(median(l_extendedprice), 6) AS mediana,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, min(l_extendedprice) AS min, max(l_extendedprice) AS max
FROM lineitem""",
    "exact_quantiles": "\nUNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS variable, count(*) AS n, round(quantile_cont({c}, 0.05), 6) AS p05,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95 FROM lineitem GROUP BY 1"""
        for c in _PSI
    ),
    "unpivot_profile": f"""WITH {RD_SQL}, l AS ({_LEVELS})
SELECT unit, 'media' AS medida, media AS valor FROM l UNION ALL SELECT unit, 'mediana', mediana FROM l
UNION ALL SELECT unit, 'p95', p95 FROM l""",
    "psi_features": _psi_sql(),
    "mann_whitney": "WITH " + _rank_sql(
        "SELECT 'n_chars' AS variable, quality <> 1 AS g1, n_chars AS x FROM labels JOIN documents USING (doc_id)"
    ),
    "hypothesis_tests": f"{LABELLED_SQL}, " + _rank_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS variable, clase = 'normal' AS g1, {c} AS x FROM cl "
            "WHERE particion = 'test' AND clase <> 'alerta'"
            for c in ("value", "cold", "load", "hora")
        )
    ),
    "hypothesis_p_values": f"{LABELLED_SQL}, " + _p_values_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS variable, clase = 'normal' AS g1, {c} AS x FROM cl "
            "WHERE particion = 'test' AND clase <> 'alerta'"
            for c in ("cold", "load", "hora")
        )
    ),
    "threshold_sketches": f"""{LABELLED_SQL}, t AS (
  SELECT unit, count(DISTINCT CAST("Time" AS DATE)) AS dias, count(*) AS n FROM cl WHERE particion = 'train' GROUP BY 1)
SELECT unit, dias, n, unnest([CAST({_MARKS[0]} AS DOUBLE), CAST({_MARKS[1]} AS DOUBLE)]) AS prob, true AS dentro FROM t""",
    "adf_lag1": f"""WITH {RD_SQL}, days AS (
  SELECT date_trunc('day', "Time") AS d, count(*) FILTER (value > 40) AS c, count(*) AS t FROM rd GROUP BY 1),
w AS (SELECT d, CAST(sum(c) OVER (ORDER BY d) AS DOUBLE) / CAST(sum(t) OVER (ORDER BY d) AS DOUBLE) AS x FROM days),
l AS (SELECT x - lag(x) OVER o AS y, lag(x) OVER o AS a, lag(x) OVER o - lag(x, 2) OVER o AS b FROM w WINDOW o AS (ORDER BY d)),
m AS (SELECT count(*) AS n, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, var_pop(y) * count(*) AS yy,
  covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS bby
  FROM l WHERE b IS NOT NULL),
e AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * bby) / (aa * bb - ab * ab) AS ka,
  (aa * bby - ab * ay) / (aa * bb - ab * ab) AS kb FROM m),
t AS (SELECT n, ka / sqrt((yy - ka * ay - kb * bby) / (n - 3) * bb / det) AS tau FROM e),
z AS (SELECT n, tau, -(CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau
  ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END) / sqrt(2.0) AS x FROM t)
SELECT round(tau, 5) AS adf_estadistico, round(CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0
  ELSE 0.5 * {_erfc_sql("x")} END, 5) AS adf_p_valor, CAST(1 AS INT) AS lags, n FROM z""",
    "adf_by_unit": f"""WITH {RD_SQL},
l AS (SELECT unit, value - lag(value) OVER o AS y, lag(value) OVER o AS a, lag(value) OVER o - lag(value, 2) OVER o AS b
  FROM rd WINDOW o AS (PARTITION BY unit ORDER BY "Time", seq)),
m0 AS (SELECT unit, count(*) AS n, var_pop(a) * count(*) AS aa, var_pop(y) * count(*) AS yy, covar_pop(a, y) * count(*) AS ay
  FROM l WHERE a IS NOT NULL GROUP BY unit),
m AS (SELECT unit, count(*) AS n, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, var_pop(y) * count(*) AS yy,
  covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS bby
  FROM l WHERE b IS NOT NULL GROUP BY unit),
e AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * bby) / (aa * bb - ab * ab) AS ka,
  (aa * bby - ab * ay) / (aa * bb - ab * ab) AS kb FROM m),
c AS (SELECT *, yy - ka * ay - kb * bby AS ssr1, yy - ay * ay / aa AS ssr0 FROM e),
p AS (SELECT *, n * ln(ssr1 / n) + 6 < n * ln(ssr0 / n) + 4 AS one FROM c)
SELECT p.unit, round(CASE WHEN one THEN ka / sqrt(ssr1 / (p.n - 3) * bb / det)
    ELSE m0.ay / m0.aa / sqrt((m0.yy - m0.ay * m0.ay / m0.aa) / (m0.n - 2) / m0.aa) END, 5) AS adf_estadistico,
  CAST(one AS INTEGER) AS lags, CASE WHEN one THEN p.n ELSE m0.n END AS n FROM p JOIN m0 ON m0.unit = p.unit""",
    "vif": f"""WITH c AS (SELECT corr({_A}, {_B}) AS ab, corr({_A}, {_C}) AS ac, corr({_B}, {_C}) AS bc FROM lineitem),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT '{_A}' AS variable, round((1 - bc * bc) / det, 6) AS vif FROM d
UNION ALL SELECT '{_B}', round((1 - ac * ac) / det, 6) FROM d
UNION ALL SELECT '{_C}', round((1 - ab * ab) / det, 6) FROM d""",
    "spearman": f"WITH r AS (SELECT {_AVG_RANK} FROM lineitem)\n" + _corr_pairs(_TRIO, "r"),
    "residual_histogram": f"""{LABELLED_SQL}, r AS (SELECT round(res, 6) AS r FROM cl WHERE particion = 'test'),
e AS (SELECT min(r) AS lo, max(r) AS hi FROM r),
b AS (SELECT CAST(least(floor((r - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, count(*) AS n FROM r, e GROUP BY 1)
SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM range(40) AS g(i) LEFT JOIN b ON b.bin = g.i""",
    "obs_pred_limits": f"""{LABELLED_SQL}
SELECT round(least(min(value), min(base)), 6) AS lo, round(greatest(max(value), max(base)), 6) AS hi
FROM cl WHERE particion = 'test'""",
    "median_by_direction": f"WITH {RD_SQL} SELECT unit, round(median(value), 6) AS value FROM rd GROUP BY 1",
    "dickey_fuller_lag0": f"""WITH {RD_SQL}, d AS (
  SELECT lag(value) OVER (ORDER BY "Time", seq) AS x, value - lag(value) OVER (ORDER BY "Time", seq) AS y FROM rd),
m AS (SELECT count(*) AS n, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy,
        covar_pop(x, y) * count(*) AS sxy FROM d WHERE x IS NOT NULL)
SELECT round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 5) AS adf_estadistico,
  CAST(0 AS INT) AS lags, n FROM m""",
}
