"""Ensemble classification of damage grades on large survey tables, with Spark DataFrames."""

from gradeloom.spec import SURVEY_FEATURES, FeatureSpec

__all__ = ["SURVEY_FEATURES", "FeatureSpec"]
