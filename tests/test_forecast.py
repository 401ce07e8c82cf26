import numpy as np
import pandas as pd

from plantpulse.operators.stationarity import adf
from plantpulse.plans.forecast import run_forecast
from plantpulse.registry.views import HOURLY


def hours(spark, units=("p", "q"), n=160):
    rng = np.random.default_rng(5)
    parts = [
        pd.DataFrame({
            "unit": u, "Time": pd.date_range("2024-01-01", periods=n, freq="h"), "y": rng.normal(size=n).cumsum(),
            "load": rng.integers(1, 9, n).astype(float), "cold": rng.uniform(size=n),
        })
        for u in units
    ]
    return spark.createDataFrame(pd.concat(parts))


def test_the_unit_may_be_part_of_the_order(spark):
    """The hourly study tells rows apart by time and unit, and tests every unit by itself."""
    assert HOURLY.unit in HOURLY.keys
    light = HOURLY.with_(trees={"random_forest_lags": {"numTrees": 2, "maxDepth": 3}, "gbt_ventanas": {"maxIter": 2}})
    df = hours(spark)
    with run_forecast(df, light) as result:
        assert {r["modelo"] for r in result.table.collect()} >= {"ridge_lags", "random_forest_lags", "gbt_ventanas"}
        assert sorted(r["unit"] for r in result.adf["por_unidad"]) == ["p", "q"]
        assert result.rows == 2 * (160 - 24 - 4)
    got = adf(df, ["Time", "unit"], "y", by=["unit"], top=2).orderBy("unit").collect()
    assert got == adf(df, ["Time"], "y", by=["unit"], top=2).orderBy("unit").collect()
