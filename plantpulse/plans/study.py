"""A whole study as one job chain, and the side-by-side comparison of two of them."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.config import CLASSES, MEDIAN_MODEL, PERSISTENCE, SPLIT, StudyConfig
from plantpulse.functions.numbers import safe_ratio
from plantpulse.operators.clusters import operating_clusters
from plantpulse.operators.collinearity import variance_inflation
from plantpulse.operators.drift import population_stability
from plantpulse.operators.ranktest import mann_whitney, spearman_matrix
from plantpulse.operators.regime import (
    histogram, level_stats, median_by_category, operating_rows, shared_limits, split_profile,
    terminal_difference,
)
from plantpulse.operators.splits import chronological_split
from plantpulse.plans.classification import assign_degradation, run_classification
from plantpulse.plans.forecast import run_forecast
from plantpulse.plans.regression import learning_curves, residual_limits, run_regression
from plantpulse.session import frozen, scratch_scope, written
from plantpulse.sources.bundle import ScoringBundle, save_bundle
from plantpulse.sources.sinks import write_csv, write_summary


def run_hypotheses(labelled: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Normal against critical: hot-cold difference, exhaust and the contrast columns."""
    frame = labelled.withColumn("ttd", terminal_difference(labelled, cfg.hot, cfg.cold))
    wanted = dict.fromkeys(["ttd", cfg.exhaust, *cfg.contrasts])
    columns = [c for c in wanted if c and c in frame.columns]
    return mann_whitney(frame, columns, "clase", CLASSES[0], CLASSES[2])


def _records(df: DataFrame) -> list[dict]:
    """Rows of a small result table (models, variables, clusters)."""
    return [r.asDict(recursive=True) for r in df.collect()]


def run_study(
    frame: DataFrame, cfg: StudyConfig, out: str | None = None, facts: dict | None = None,
    with_grid: bool = True, parallelism: int = 4, restarts: int = 10, samme_rounds: int = 40,
) -> dict:
    """Run every step on a cleaned table and return the summary document.

    Scratch tables are deleted and caches released before it returns.
    """
    with scratch_scope(frame.sparkSession), ExitStack() as caches:
        return _run_study(frame, cfg, out, facts, with_grid, parallelism, restarts, samme_rounds, caches)


def _run_study(
    frame: DataFrame, cfg: StudyConfig, out: str | None, facts: dict | None,
    with_grid: bool, parallelism: int, restarts: int, samme_rounds: int, caches: ExitStack,
) -> dict:
    """The regime-filtered table is written once, partitioned by split; every later step
    reads it with its own columns, and a filter on the split skips the other parts.
    """
    spark = frame.sparkSession
    target = cfg.target
    regime = operating_rows(frame, cfg)
    table = written(
        chronological_split(regime, cfg.keys, cfg.train_fraction, cfg.val_fraction), "study", [SPLIT]
    )
    train = table.filter(F.col(SPLIT) == "train")
    test = table.filter(F.col(SPLIT) == "test")
    regression = caches.enter_context(run_regression(table, cfg, with_grid, parallelism))
    alert, critical = residual_limits(table, cfg, regression.baseline)
    labelled = assign_degradation(table, target, regression.baseline.predicted(), alert, critical)
    classes = caches.enter_context(run_classification(labelled, cfg, samme_rounds, parallelism))
    forecast = caches.enter_context(run_forecast(table.drop(SPLIT), cfg, parallelism))
    curve, k, _, clusters = operating_clusters(
        train, cfg.keys, list(cfg.drivers), target, restarts=restarts, seed=cfg.seed
    )
    labelled_test = labelled.filter(F.col(SPLIT) == "test")
    hypotheses = run_hypotheses(labelled_test, cfg)
    monitored = [*cfg.drivers, target]
    psi = population_stability(train, test, monitored, cfg.psi_bins)
    period = {r[SPLIT]: r.asDict() for r in split_profile(table, cfg.time, list(cfg.profile)).collect()}
    chosen = regression.gate["modelo_flexible"]
    shown = regression.scored.filter(F.col(SPLIT) == "test")
    summary = {
        **(facts or {}),
        "estudio": cfg.name,
        "filas_limpias": frame.count(),
        "filas_operacion": sum(p["n"] for p in period.values()),
        **{s: period[s]["n"] for s in period},
        "inicio": min(p["inicio"] for p in period.values()),
        "fin": max(p["fin"] for p in period.values()),
        "particiones": period,
        "vacio_operacion": _records(level_stats(table, target))[0],
        "regresion": _records(regression.table),
        "ganador_regresion": regression.winner,
        **{k_: regression.gate[k_] for k_ in ("modelo_flexible", "flexible_supera_mediana", "modelo_servido")},
        "baseline_name": cfg.baseline_name,
        "rejilla": regression.grid,
        "importancia": [{"variable": v, "importancia": i} for v, i in regression.importance],
        "coef_linea_base_escalada": dict(zip(regression.baseline.drivers, regression.baseline.per_sd)),
        "test_modelo_desplegado": regression.deployed_test,
        "clasificacion": _records(classes.table),
        "ganador_clasificacion": classes.winner,
        "modelo_matriz": classes.matrix_model,
        "matriz_test": _records(classes.matrix.orderBy("ord")),
        "clases": CLASSES,
        "conteo_train": {r["clase"]: r["n"] for r in classes.train_counts.collect()},
        "umbral_residual": {"alerta": alert, "critico": critical},
        "pronostico": _records(forecast.table),
        "ganador_pronostico": forecast.winner,
        "pronostico_filas": forecast.rows,
        "horizonte_min": forecast.horizon_minutes,
        **{k_: forecast.adf[k_] for k_ in ("adf_estadistico", "adf_p_valor")},
        **({"adf_por_unidad": forecast.adf["por_unidad"]} if forecast.adf["por_unidad"] else {}),
        "clusters": {
            "silhouette": [{"k": a, "silhouette": s} for a, s in curve],
            "k": k,
            "perfil": _records(clusters),
        },
        "hipotesis": {r["variable"]: r for r in _records(hypotheses)},
        "psi": {r["variable"]: r for r in _records(psi)},
        "vif": _records(variance_inflation(train, list(cfg.drivers))),
        "curvas": _records(learning_curves(train, cfg, parallelism=parallelism)),
        "figuras": {
            "residual": _records(histogram(labelled_test, "residual_base")),
            "limites": _records(shared_limits(shown, target, f"p_{chosen}"))[0],
            "spearman": _records(spearman_matrix(test, monitored)),
        },
    }
    if "cf" in table.columns:
        cf = _records(level_stats(table, "cf"))[0]
        summary["cf"] = {m: cf[m] for m in ("min", "mediana", "max")}
    if "direccion" in table.columns:
        summary["vacio_por_direccion"] = _records(median_by_category(table, "direccion", target))
    if out:
        base = out.rstrip("/")
        write_csv(regression.table.coalesce(1), f"{base}/regresion.csv")
        write_csv(classes.table.coalesce(1), f"{base}/clasificacion.csv")
        write_csv(forecast.table.coalesce(1), f"{base}/pronostico.csv")
        write_csv(forecast.preview, f"{base}/pronostico_reciente.csv")
        write_csv(observed_predicted(shown, cfg, f"p_{chosen}"), f"{base}/observado_predicho.csv")
        write_summary(spark, summary, f"{base}/summary.json")
        promoted = regression.gate["flexible_supera_mediana"]
        save_bundle(
            spark,
            ScoringBundle(
                served=regression.deployed if promoted else regression.baseline,
                baseline=regression.baseline,
                model_name=regression.gate["modelo_servido"],
                drivers=tuple(cfg.drivers),
                alert=alert,
                critical=critical,
            ),
            f"{base}/bundle",
        )
    return summary


def observed_predicted(scored: DataFrame, cfg: StudyConfig, predicted: str) -> DataFrame:
    """Every scored row's time, observed and predicted value, and what is left of it."""
    gap = F.col(cfg.target) - F.col(predicted)
    return scored.select(
        *cfg.keys, F.col(cfg.target).alias("observado"), F.col(predicted).alias("predicho"), gap.alias("residual")
    )


def study_metrics(
    levels: DataFrame, regression: DataFrame, forecast: DataFrame, baseline_name: str,
    to_mbar: float,
) -> DataFrame:
    """Long (metrica, valor) table of the figures the comparison puts side by side."""
    test = F.col(SPLIT) == "test"

    def of(table: DataFrame, model: str, metric: str, name: str) -> DataFrame:
        rows = table.filter(test & (F.col("modelo") == model))
        return rows.select(F.lit(name).alias("metrica"), F.col(metric).alias("valor"))

    level = levels.select(
        F.explode(
            F.create_map(
                F.lit("mediana"), F.col("mediana"),
                F.lit("mediana_mbar"), F.col("mediana") * F.lit(to_mbar),
                F.lit("p95"), F.col("p95"),
            )
        ).alias("metrica", "valor")
    )
    best = regression.filter(test).agg(F.min("mae").alias("valor")).select(
        F.lit("mejor_mae").alias("metrica"), "valor"
    )
    parts = [
        level,
        best,
        of(regression, MEDIAN_MODEL, "mae", "mae_mediana"),
        *[of(regression, baseline_name, m, f"{m}_linea") for m in ("mae", "mape_pct", "r2")],
        of(forecast, PERSISTENCE, "mae", "mae_persistencia"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return frozen(table)


RELATIVE = {"mae_linea_relativo": "mae_linea", "mae_persistencia_relativo": "mae_persistencia"}


def with_relative(metrics: DataFrame, level: str = "mediana") -> DataFrame:
    """Append errors divided by the median level (NULL when the level is zero)."""
    wanted = {source: name for name, source in RELATIVE.items()}
    base = metrics.agg(F.max(F.when(F.col("metrica") == level, F.col("valor")))).first()[0]
    extra = metrics.filter(F.col("metrica").isin(list(wanted))).select(
        F.concat("metrica", F.lit("_relativo")).alias("metrica"),
        safe_ratio(F.col("valor"), F.lit(base).cast("double")).alias("valor"),
    )
    return metrics.unionByName(extra)


def compare(surface: DataFrame, air_cooled: DataFrame) -> DataFrame:
    """(metrica, superficie, aerocondensador): full outer join of two metric tables."""
    left = surface.select("metrica", F.col("valor").alias("superficie"))
    right = air_cooled.select("metrica", F.col("valor").alias("aerocondensador"))
    joined = left.join(right, "metrica", "full")
    return joined.withColumn("razon", safe_ratio(F.col("aerocondensador"), F.col("superficie")))


def compare_summaries(
    spark: SparkSession, surface: dict, air_cooled: dict, surface_mbar: float, air_mbar: float
) -> DataFrame:
    """The comparison from two saved summaries, without retraining."""

    def rows(s: dict, to_mbar: float, cold: str) -> DataFrame:
        reg = spark.createDataFrame(s["regresion"])
        fc = spark.createDataFrame(s["pronostico"])
        levels = spark.createDataFrame([s["vacio_operacion"]])
        long = with_relative(study_metrics(levels, reg, fc, s["baseline_name"], to_mbar))
        ttd = s["hipotesis"].get("ttd") or {}
        more = [
            ("ttd_normal", ttd.get("mediana_normal")),
            ("ttd_critico", ttd.get("mediana_critico")),
            ("ttd_p_valor", ttd.get("p_valor")),
            ("psi_frio", (s["psi"].get(cold) or {}).get("psi")),
            ("filas", float(s["filas_operacion"])),
            ("pronostico_filas", float(s["pronostico_filas"])),
            ("horizonte_min", float(s["horizonte_min"])),
            ("mejor_mae_pronostico", _test_mae(s["pronostico"], s["ganador_pronostico"])),
            ("cf_mediana", (s.get("cf") or {}).get("mediana")),
        ]
        return long.unionByName(spark.createDataFrame(more, "metrica string, valor double"))

    from plantpulse.config import AIR_COOLED, SURFACE

    return compare(
        rows(surface, surface_mbar, SURFACE.cold), rows(air_cooled, air_mbar, AIR_COOLED.cold)
    )


def _test_mae(rows: list[dict], model: str) -> float | None:
    return next((r["mae"] for r in rows if r["modelo"] == model and r[SPLIT] == "test"), None)


# What the comparison says in words: winners, what is served, and the period.
LABELS = (
    "ganador_regresion", "modelo_servido", "ganador_clasificacion", "ganador_pronostico", "inicio", "fin",
)


def compare_labels(spark: SparkSession, surface: dict, air_cooled: dict) -> DataFrame:
    """(dato, superficie, aerocondensador) of the two summaries, as text."""
    rows = [(n, *(None if s.get(n) is None else str(s[n]) for s in (surface, air_cooled))) for n in LABELS]
    return spark.createDataFrame(rows, "dato string, superficie string, aerocondensador string")
