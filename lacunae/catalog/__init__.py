"""Queries over the given tables, and the same results in SQL."""

from . import answers, folds, holes, imputers, models, prompts, runs, scores, tables, telemetry

PARTS = (tables, holes, imputers, models, prompts, answers, folds, scores, runs, telemetry)


def all_queries() -> dict:
    return {name: call for part in PARTS for name, call in part.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.SQL.items()}
