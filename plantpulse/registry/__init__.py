"""Queries on the supplied tables, each with the SQL that states the same answer."""

from plantpulse.registry import cleaning, landing, models, refits, reports, scores, series, serving, statistics

_PARTS = (cleaning, series, scores, statistics, models, refits, serving, landing, reports)


def queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
