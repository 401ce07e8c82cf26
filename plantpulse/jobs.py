"""The jobs a user submits: both studies, their comparison, and scoring a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.config import AIR_COOLED, SURFACE, StudyConfig
from plantpulse.plans.scoring import score_file
from plantpulse.plans.study import compare_labels, compare_summaries, run_study
from plantpulse.session import scratch_scope
from plantpulse.sources.air_cooled import load_air_cooled
from plantpulse.sources.bundle import load_bundle
from plantpulse.sources.historian import load_historian
from plantpulse.sources.sinks import read_summary, write_csv

TARGET_TAG = "FNX:S1_EV_P.PV"


def train_surface(
    spark: SparkSession, extract: str, cache: str, out: str, cfg: StudyConfig = SURFACE, **options
) -> dict:
    """Clean the extract (or reuse a fresh copy) and run the surface study."""
    frame = load_historian(spark, extract, cache, cfg.time, TARGET_TAG)
    return run_study(frame, cfg, out, **options)


def train_air_cooled(
    spark: SparkSession, extract: str, out: str, cfg: StudyConfig = AIR_COOLED, **options
) -> dict:
    with scratch_scope(spark):
        frame, facts = load_air_cooled(spark, extract, cfg.rated_mw)
        return run_study(frame, cfg, out, facts, **options)


def compare_studies(spark: SparkSession, surface_out: str, air_out: str, out: str) -> DataFrame:
    """Comparison tables from the two saved summaries, without retraining.

    Figures are written to ``out`` and returned; winners and periods to ``out``_textos.
    """
    surface = read_summary(spark, f"{surface_out}/summary.json")
    air_cooled = read_summary(spark, f"{air_out}/summary.json")
    table = compare_summaries(spark, surface, air_cooled, SURFACE.to_mbar, AIR_COOLED.to_mbar)
    write_csv(table.coalesce(1), out)
    write_csv(compare_labels(spark, surface, air_cooled).coalesce(1), f"{out.rstrip('/')}_textos")
    return table


def predict(spark: SparkSession, study_out: str, records: str, out: str) -> DataFrame:
    return score_file(spark, load_bundle(spark, f"{study_out}/bundle"), records, out)
