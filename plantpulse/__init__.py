"""Condition monitoring over process-historian tables, on Spark DataFrames."""

from plantpulse.config import AIR_COOLED, SURFACE, StudyConfig

__all__ = ["AIR_COOLED", "SURFACE", "StudyConfig"]
