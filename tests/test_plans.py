"""Physical plans: what is pushed to the scan, what is shuffled, what stays in the JVM."""

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.collinearity import variance_inflation
from plantpulse.operators.drift import binned_counts, reference_cuts
from plantpulse.operators.metrics import classification_scores, regression_scores
from plantpulse.operators.ordered import quantiles
from plantpulse.operators.regime import operating_rows
from plantpulse.operators.splits import chronological_split, split_conditions
from plantpulse.operators.windows import forecast_columns
from plantpulse.registry.serving import BUNDLE, FIELDS, OBSERVED
from plantpulse.plans.scoring import score_records, validate_records
from plantpulse.registry.views import READINGS

SF = "/root/testdata/sf0.01"
ORDER = ["o_orderdate", "o_orderkey"]
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython", "ArrowEvalPython")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan(df):
    return next(line for line in plan(df).splitlines() if "FileScan" in line)


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_one_part_of_a_split_is_a_pushed_filter_without_a_shuffle(orders):
    part = split_conditions(orders, ORDER, 0.7, 0.15)
    for name in ("train", "val", "test"):
        df = orders.filter(part[name]).select("o_totalprice")
        assert "Exchange" not in plan(df)
        pushed = scan(df).split("PushedFilters:")[1]
        assert "o_orderdate" in pushed and "ThanOrEqual(o_orderdate" in pushed
    labelled = chronological_split(orders, ORDER, 0.7, 0.15)
    assert "Exchange" not in plan(labelled)


def test_regime_filter_is_pushed_and_columns_pruned(spark):
    cfg = READINGS.with_(target="l_extendedprice", drivers=("l_quantity", "l_tax"), baseline=("l_quantity",),
                         load="l_quantity", cold="l_tax", min_load=10.0, target_range=(1.0, 2.0), contrasts=(), profile=())
    df = operating_rows(spark.read.parquet(f"{SF}/lineitem.parquet"), cfg).select("l_tax")
    text = scan(df)
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "LessThanOrEqual(l_extendedprice,2.0)" in text
    assert "l_shipdate" not in text.split("ReadSchema:")[1]


def test_lags_take_one_shuffle_on_unit_and_bucket(events):
    df = forecast_columns(events.select("ts", "event_id", "event_type", "value"), "ts", "event_id", "value",
                          [1, 2, 4], 2, 60.0, "event_type")
    text = plan(df)
    assert text.count("Exchange hashpartitioning(event_type") == 1 and text.count("Exchange") == 1
    assert "_bucket" in text and not any(b in text for b in BAD)


def test_quantiles_and_bins_never_gather_rows(events):
    for by in ([], ["event_type"]):
        text = plan(quantiles(events, ["value"], [0.5, 0.95], by, few_groups=True))
        assert not any(b in text for b in BAD)
    cuts = reference_cuts(events, ["value"])
    text = plan(binned_counts(events, ["value"], cuts, F.lit(True)))
    assert text.count("Exchange hashpartitioning") == 1 and not any(b in text for b in BAD)


def test_scores_are_one_partial_and_one_final_aggregate(events):
    df = events.withColumns({"particion": F.lit("val"), "p": F.lit(1.0), "c": F.col("event_type")})
    text = plan(regression_scores(df, "value", {"a": "p", "b": "value"}))
    assert text.count("Exchange") == 1 and "partial_avg" in text and not any(b in text for b in BAD)
    text = plan(classification_scores(df, "event_type", {"a": "c"}))
    assert not any(b in text for b in BAD)


def test_scoring_is_a_projection(events):
    records = events.select("ts", "event_id", F.lit(1.0).alias("k"), "user_id", "value")
    scored = score_records(validate_records(records, FIELDS, OBSERVED)[0], BUNDLE, FIELDS, "value", ["event_id"])
    text = plan(scored)
    assert "Exchange" not in text and not any(b in text for b in BAD)


def test_vif_reads_only_its_columns(spark):
    rows = variance_inflation(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_quantity", "l_tax"]).collect()
    assert len(rows) == 2
