import json

import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from plantpulse.config import RECORD_FIELDS, SURFACE
from plantpulse.models.catalog import FEATURES, assemble
from plantpulse.models.linear import LinearFit
from plantpulse.plans.scoring import (
    OBSERVED, RECORD_SCHEMA, read_batch, score_file, score_records, service_counters, validate_records,
)
from plantpulse.sources.bundle import ScoringBundle, load_bundle, save_bundle
from plantpulse.sources.sinks import json_rows, plain, read_records, read_summary, write_json, write_summary

RECORD = dict(temperatura_agua_mar=60.0, potencia_tv_mw=170.0, potencia_tg11_mw=160.0, potencia_tg12_mw=155.0,
              presion_eyectores=150.0, presion_vapor_lp=55.0, flujo_fw_lp=180.0, vacio_observado=1.35)
ZERO = (0.0,) * 7
BASE = LinearFit(("temp_agua_mar", "potencia_tv"), 0.2, (0.015, 0.001), (0.0, 0.0))
BUNDLE = ScoringBundle(LinearFit(SURFACE.drivers, 0.1, (0.02, *ZERO[1:]), ZERO), BASE, "ridge",
                       SURFACE.drivers, 0.05, 0.20)


def records(spark, *changes):
    return spark.createDataFrame([{**RECORD, **c} for c in changes], RECORD_SCHEMA)


def test_scored_fields(spark):
    rows = score_records(records(spark, {}, {OBSERVED: 1.27}, {OBSERVED: 1.5}, {OBSERVED: None}), BUNDLE).collect()
    assert rows[0].asDict() == {
        "vacio_esperado": 1.3, "vacio_linea_base_agua_carga": 1.27, "modelo": "ridge", "vacio_observado": 1.35,
        "residual_modelo": 0.05, "residual_linea_base": 0.08, "clase": "alerta", "anomalia": False,
        "umbral_anomalia": 0.2,
    }
    assert rows[1]["clase"] == "normal"
    assert (rows[2]["clase"], rows[2]["anomalia"]) == ("critico", True)
    empty = rows[3].asDict()
    assert empty["vacio_esperado"] == 1.3
    assert all(empty[c] is None for c in ("vacio_observado", "residual_modelo", "clase", "anomalia", "umbral_anomalia"))


def test_counters_ignore_records_without_reading(spark):
    scored = score_records(records(spark, {}, {OBSERVED: 1.5}, {OBSERVED: None}, {OBSERVED: float("nan")}), BUNDLE)
    assert tuple(service_counters(scored).first()) == (4, 1)


def test_range_contract(spark):
    df = records(spark, {}, {"potencia_tv_mw": -5.0}, {"temperatura_agua_mar": 120.0, "flujo_fw_lp": 0.0},
                 {OBSERVED: None}, {OBSERVED: 36.0}, {"presion_vapor_lp": None, "potencia_tg11_mw": 401.0})
    good, bad = validate_records(df)
    assert good.count() == 3
    reasons = sorted(tuple(r["reject_reason"]) for r in bad.collect())
    assert reasons == [("potencia_tg11_mw", "presion_vapor_lp"), ("potencia_tv_mw",), ("vacio_observado",)]


def test_batch_file(spark, tmp_path):
    names = [*RECORD_FIELDS, OBSERVED]
    path = tmp_path / "lote.csv"
    path.write_text("\n".join([",".join(names), ",".join(str(RECORD[n]) for n in names),
                               ",".join(str(RECORD[n]) for n in names[:-1]) + ","]) + "\n")
    out = str(tmp_path / "out")
    scored = score_file(spark, BUNDLE, str(path), out)
    assert scored.filter("clase = 'alerta'").count() == 1 and scored.filter("clase is null").count() == 1
    assert spark.read.option("header", True).csv(out).count() == 2
    with pytest.raises(ValueError):
        read_batch(spark, str(tmp_path / "lote.txt"))
    path.write_text(",".join(names) + "\n")
    with pytest.raises(ValueError):
        read_batch(spark, str(path))
    path.write_text("")
    with pytest.raises(ValueError):
        read_batch(spark, str(path))
    path.write_text("a,b\n1,2\n")
    with pytest.raises(KeyError):
        read_batch(spark, str(path))


def test_json_in_and_out(spark, tmp_path):
    one = tmp_path / "snapshot.json"
    one.write_text(json.dumps(RECORD, indent=2))
    scored = score_records(read_records(spark, str(one), RECORD_SCHEMA), BUNDLE)
    text = json_rows(scored.withColumn("x", F.lit(float("inf")))).first()["value"]
    assert json.loads(text)["x"] is None and json.loads(text)["clase"] == "alerta"
    write_json(scored, str(tmp_path / "rows"))
    write_summary(spark, {"a": float("nan"), "b": [1, {"c": 2.5}]}, str(tmp_path / "s"))
    assert read_summary(spark, str(tmp_path / "s")) == {"a": None, "b": [1, {"c": 2.5}]}
    assert plain((1, float("inf"))) == [1, None]


def test_bundle_round_trip(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, str(tmp_path / "none"))
    df = records(spark, {}, {OBSERVED: 1.5, "temperatura_agua_mar": 70.0})
    save_bundle(spark, BUNDLE, str(tmp_path / "linear"))
    again = load_bundle(spark, str(tmp_path / "linear"))
    assert again == BUNDLE
    renamed = df.select(*[F.col(f).alias(a) for f, (a, _, _) in RECORD_FIELDS.items()], F.col(OBSERVED).alias("y"))
    tree = DecisionTreeRegressor(featuresCol=FEATURES, labelCol="y", minInstancesPerNode=1).fit(
        assemble(renamed, list(SURFACE.drivers))
    )
    bundle = ScoringBundle(tree, BASE, "arbol", SURFACE.drivers, 0.05, 0.2)
    save_bundle(spark, bundle, str(tmp_path / "tree"))
    again = load_bundle(spark, str(tmp_path / "tree"))
    want = score_records(df, bundle).collect()
    assert score_records(df, again).collect() == want
    assert {r["vacio_esperado"] for r in want} == {1.35, 1.5}
