"""Preparation of the two surveys, from raw tables to the common feature layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.ground_motion import Event, pga_g
from gradeloom.functions.survey import (
    above,
    align_columns,
    at_most,
    damage_class,
    drop_at,
    metres_to_feet,
    miles_to_km,
    ratio,
    sq_metres_to_sq_feet,
)
from gradeloom.operators.impute import Imputer, ImputerModel
from gradeloom.spec import (
    ENGINEERED_MAX_AGE,
    FOREIGN_CONSTANTS,
    FOREIGN_KEPT,
    FOREIGN_RENAMES,
    HOME_DROPPED,
    HOME_RENAMES,
    SURVEY_FEATURES,
)

PGA_DIGITS = 7


def add_ground_motion(raw: DataFrame, event: Event = Event()) -> DataFrame:
    """Replace the first column, a distance in miles, by the peak ground acceleration in g."""
    distance = miles_to_km(F.col(f"`{raw.columns[0]}`"))
    pga = F.round(pga_g("_km", event=event), PGA_DIGITS)
    return drop_at(raw.withColumn("_km", distance).withColumn("PGA_g", pga).drop("_km"), 0)


def shape_home(raw: DataFrame) -> DataFrame:
    """Rename and drop the raw columns and make the target start at 0."""
    return (
        raw.withColumnsRenamed(HOME_RENAMES)
        .drop(*HOME_DROPPED)
        .withColumn(SURVEY_FEATURES.target, F.col(SURVEY_FEATURES.target) - 1)
    )


def shape_foreign(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bring the foreign survey to the home layout; rows without a known grade are left out."""
    grade = SURVEY_FEATURES.target
    df = raw.select(*keep, *[F.col(f"`{c}`") for c in FOREIGN_KEPT]).withColumns(
        {
            "Total Height": metres_to_feet(F.col("`Total Height`")),
            "Floor Area": sq_metres_to_sq_feet(F.col("`Floor Area`")),
            "Structural Damage (5-class)": damage_class(F.col("`Structural Damage (5-class)`")),
        }
    )
    df = df.withColumn("per-height_ft_pre_eq", ratio(F.col("`Total Height`"), F.col("`No Stories`")))
    df = df.withColumnsRenamed(FOREIGN_RENAMES).drop("Total Height").filter(F.col(grade).isNotNull())
    return df.withColumns({c: F.lit(v) for c, v in FOREIGN_CONSTANTS.items()}).withColumns(
        {
            "has_superstructure_rc_non_engineered": above(F.col("age_building"), ENGINEERED_MAX_AGE),
            "has_superstructure_rc_engineered": at_most(F.col("age_building"), ENGINEERED_MAX_AGE),
        }
    )


def home_imputer() -> Imputer:
    """Median of the measures, mode of the categories; the flags of the home survey are complete."""
    return Imputer(SURVEY_FEATURES.numeric, SURVEY_FEATURES.categories)


def foreign_imputer() -> Imputer:
    return Imputer(SURVEY_FEATURES.numeric, SURVEY_FEATURES.categories + SURVEY_FEATURES.flags)


def prepare_home(raw: DataFrame, imputer: ImputerModel | None = None) -> DataFrame:
    """Home survey with ground motion to its processed form, the target last.

    Pass an ``imputer`` fitted on the training part to keep test rows out of the statistics.
    """
    df = shape_home(raw)
    model = imputer or home_imputer().fit(df)
    return align_columns(model.transform(df), list(df.columns), SURVEY_FEATURES.target)


def prepare_foreign(
    raw: DataFrame, home_columns: list[str], imputer: ImputerModel | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Foreign survey to its processed form, in the column order of the home survey."""
    df = shape_foreign(raw, keep)
    model = imputer or foreign_imputer().fit(df)
    return align_columns(model.transform(df), home_columns, SURVEY_FEATURES.target)
