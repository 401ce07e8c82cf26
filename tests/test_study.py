import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plantpulse.config import AIR_COOLED, CLASSES, SURFACE
from plantpulse.plans.scoring import RECORD_SCHEMA, score_records
from plantpulse.plans.study import compare_summaries, run_study
from plantpulse.sources.bundle import load_bundle
from plantpulse.sources.sinks import read_summary

LIGHT = {"random_forest": {"numTrees": 4}, "gbm": {"maxIter": 3}, "gbt_hist": {"maxIter": 3},
         "gbt_grid": {"maxIter": 2}, "random_forest_lags": {"numTrees": 4}, "gbt_ventanas": {"maxIter": 3}}


def surface_frame(spark, n=900):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"Time": pd.date_range("2024-01-01", periods=n, freq="15min"), "seq": range(n)})
    for c in SURFACE.drivers:
        pdf[c] = rng.normal(100, 5, n)
    pdf["potencia_tv"] = np.where(np.arange(n) % 50 == 0, 10.0, pdf.potencia_tv)
    wave = np.sin(np.arange(n) / 40)
    pdf["temp_agua_mar"] = 60 + 3 * wave
    pdf["vacio"] = 0.5 + 0.01 * pdf.temp_agua_mar + 0.001 * pdf.potencia_tv + rng.gamma(1, 0.02, n)
    pdf["temp_condensador"] = pdf.temp_agua_mar + 20 * pdf.vacio
    pdf["temp_escape"] = pdf.temp_condensador + 5
    return spark.createDataFrame(pdf)


def air_frame(spark, n=700):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"Time": pd.date_range("2024-05-01", periods=n, freq="1min"), "seq": range(n)})
    for c in AIR_COOLED.drivers:
        pdf[c] = rng.normal(20, 2, n)
    pdf["cf"] = pdf.potencia_mw / 300
    pdf["vacio"] = 0.05 + 0.002 * pdf.temp_ambiente + rng.gamma(1, 0.003, n)
    pdf["temp_salida_bp"] = pdf.temp_ambiente + 25 + 50 * pdf.vacio
    pdf["direccion"] = np.where(np.arange(n) % 2 == 0, "N", "S")
    return spark.createDataFrame(pdf)


def test_two_studies_and_their_comparison(spark, tmp_path):
    cfg = SURFACE.with_(lags=(1, 2, 4), daily_lag=4, trees=LIGHT, preview_rows=20)
    out = str(tmp_path / "surface")
    s = run_study(surface_frame(spark), cfg, out, restarts=1, samme_rounds=3)
    assert s["filas_operacion"] == 900 - 18 and s["train"] + s["val"] + s["test"] == s["filas_operacion"]
    assert {r["modelo"] for r in s["regresion"]} >= {"mediana_entrenamiento", "lineal_agua_y_carga", "ridge", "gbt_grid"}
    assert len(s["clasificacion"]) == 12 and sum(s["conteo_train"].values()) == s["train"]
    assert set(s["conteo_train"]) <= set(CLASSES)
    assert {r["modelo"] for r in s["pronostico"]} >= {"persistencia", "persistencia_diaria", "ridge_lags"}
    assert set(s["hipotesis"]) == {"ttd", "temp_escape", "presion_eyectores", "temp_agua_mar"}
    assert {"psi", "banda"} <= set(s["psi"]["vacio"]) and len(s["vif"]) == 7
    assert 2 <= s["clusters"]["k"] <= 6 and len(s["clusters"]["perfil"]) == s["clusters"]["k"]
    assert spark.read.option("header", True).csv(f"{out}/regresion.csv").count() == len(s["regresion"])
    assert spark.read.option("header", True).csv(f"{out}/pronostico_reciente.csv").count() == 20
    assert spark.read.option("header", True).csv(f"{out}/observado_predicho.csv").count() == s["test"]
    saved = read_summary(spark, f"{out}/summary.json")
    assert saved["modelo_servido"] == s["modelo_servido"] and len(saved["regresion"]) == len(s["regresion"])
    bundle = load_bundle(spark, f"{out}/bundle")
    assert bundle.model_name == s["modelo_servido"] and bundle.critical == s["umbral_residual"]["critico"]
    record = spark.createDataFrame([(60.0, 100.0, 100.0, 100.0, 100.0, 100.0, 100.0, 9.0)], RECORD_SCHEMA)
    assert score_records(record, bundle).first()["clase"] == "critico"

    a = run_study(air_frame(spark), AIR_COOLED.with_(trees=LIGHT, lags=(5, 10), horizon=6), None,
                  {"filas_archivo": 700}, with_grid=False, restarts=1, samme_rounds=2)
    assert a["filas_archivo"] == 700 and "min" in a["cf"]
    assert [r["direccion"] for r in sorted(a["vacio_por_direccion"], key=lambda r: r["vacio"])] and len(a["vacio_por_direccion"]) == 2
    table = {r["metrica"]: r for r in compare_summaries(spark, saved, a, SURFACE.to_mbar, AIR_COOLED.to_mbar).collect()}
    level = table["mediana_mbar"]
    assert abs(level["superficie"] - saved["vacio_operacion"]["mediana"] * 33.8639) < 1e-9
    assert abs(level["razon"] - level["aerocondensador"] / level["superficie"]) < 1e-12
    line = [r for r in saved["regresion"] if r["modelo"] == "lineal_agua_y_carga" and r["particion"] == "test"][0]
    assert abs(table["mae_linea_relativo"]["superficie"] - line["mae"] / saved["vacio_operacion"]["mediana"]) < 1e-12
    assert {"ttd_normal", "psi_frio", "mae_persistencia_relativo", "mejor_mae"} <= set(table)


def as_csv(df, path, header=None):
    """Rows as CSV text in a few files; tags may hold dots and colons."""
    pdf = df.toPandas()
    if header:
        pdf = pdf.rename(columns=header)
    path.mkdir()
    for i in range(0, len(pdf), 400):
        pdf[i:i + 400].to_csv(path / f"part-{i:05d}.csv", index=False)
    return str(path)


def cached(spark):
    return {int(n) for n in spark.sparkContext._jsc.getPersistentRDDs().keySet()}


def leftovers(spark, root):
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(x.getPath()) for x in fs.listStatus(fs_path)} if fs.exists(fs_path) else set()


def test_both_studies_run_from_csv(spark, tmp_path):
    """Clean, split, fit, compare and score, with repeated and crowded times."""
    from plantpulse.config import TAGS
    from plantpulse.jobs import TARGET_TAG, compare_studies, predict, train_air_cooled, train_surface
    from plantpulse.session import checkpoint_root

    root = checkpoint_root(spark)
    before, held = leftovers(spark, root), cached(spark)
    frame = surface_frame(spark, 700).drop("seq", "temp_condensador", "temp_escape")
    tags = {alias: tag for tag, _, alias, _ in TAGS if alias} | {"vacio": TARGET_TAG}
    twice = frame.union(frame.limit(30)).orderBy("Time")
    cfg = SURFACE.with_(lags=(1, 2, 4), daily_lag=4, trees=LIGHT, preview_rows=20)
    surface = str(tmp_path / "surface")
    s = train_surface(
        spark, as_csv(twice, tmp_path / "s-csv", tags), str(tmp_path / "cache"), surface, cfg,
        restarts=1, samme_rounds=2,
    )
    assert s["filas_limpias"] == 700 and s["train"] + s["val"] + s["test"] == s["filas_operacion"] == 700 - 14

    pdf = air_frame(spark, 600).toPandas()
    # A third of the rows share one time: only their reading order tells them apart.
    pdf.loc[200:399, "Time"] = pdf.loc[200, "Time"]
    raw = pd.DataFrame({
        "Time": pdf.Time, "TV_BP_Pout": pdf.vacio, "CF": pdf.cf, "T_ambient": pdf.temp_ambiente,
        "Wind_speed": pdf.viento, "Wind_dir": pdf.direccion, "BP_Flow": pdf.flujo_bp, "TV_BP_Tout": pdf.temp_salida_bp,
    })
    raw.loc[5, "Wind_dir"] = "---"
    air = str(tmp_path / "air")
    a = train_air_cooled(
        spark, as_csv(spark.createDataFrame(raw), tmp_path / "a-csv"), air,
        AIR_COOLED.with_(trees=LIGHT, lags=(5, 10), horizon=6), with_grid=False, restarts=1, samme_rounds=2,
    )
    assert a["filas_archivo"] == 600 and a["filas_validas"] == 599
    assert [a[p] for p in ("train", "val", "test")] == [419, 90, 90]
    table = compare_studies(spark, surface, air, str(tmp_path / "comparison"))
    assert {"mae_persistencia", "psi_frio"} <= {r["metrica"] for r in table.collect()}
    record = spark.createDataFrame([(60.0, 100.0, 100.0, 100.0, 100.0, 100.0, 100.0, 9.0)], RECORD_SCHEMA)
    record.coalesce(1).write.option("header", True).csv(str(tmp_path / "records.csv"))
    assert predict(spark, surface, str(tmp_path / "records.csv"), str(tmp_path / "scored")).first()["clase"] == "critico"
    assert leftovers(spark, root) == before
    assert cached(spark) <= held
