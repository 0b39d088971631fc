"""Checked queries, grouped by theme. Importing this package fills the registry."""
from __future__ import annotations

from .registry import QUERIES, SQL
from . import panel_queries, cleaning_queries, feature_queries, rule_queries, evaluation_queries, matching_queries, source_queries, model_queries


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(SQL)


def flagship(spark, sf_dir):
    return QUERIES["flagship_change_days"](spark, sf_dir)
