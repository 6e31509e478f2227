"""Column groups of the survey tables and the values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Column names of the processed survey tables.
NUMERIC_COLUMNS = (
    "PGA_g",
    "count_floors_pre_eq",
    "age_building",
    "plinth_area_sq_ft",
    "per-height_ft_pre_eq",
)
FLAG_COLUMNS = (
    "has_superstructure_mud_mortar_stone",
    "has_superstructure_stone_flag",
    "has_superstructure_cement_mortar_stone",
    "has_superstructure_cement_mortar_brick",
    "has_superstructure_timber",
    "has_superstructure_bamboo",
    "has_superstructure_rc_non_engineered",
    "has_superstructure_rc_engineered",
    "has_superstructure_other",
)
CATEGORY_COLUMNS = ("foundation_type", "roof_type", "ground_floor_type")
TARGET_COLUMN = "damage_grade"

# Raw survey headers that are renamed or dropped.
HOME_RENAMES = {
    "roof_type(Bamboo/Timber-Heavy roof=0; Bamboo/Timber-Light roof=1; RCC/RB/RBC=2)": "roof_type",
    "district_distance_to_earthquakecenter(mi)": "distance",
}
HOME_DROPPED = (
    "technical_solution_proposed",
    "condition_post_eq",
    "vdcmun_id",
    "ward_id",
    "land_surface_condition",
    "has_superstructure_mud_mortar_brick",
    "position",
    "has_superstructure_adobe_mud",
)
FOREIGN_KEPT = (
    "Age",
    "No Stories",
    "PGA_max",
    "Total Height",
    "Floor Area",
    "Structural Damage (5-class)",
)
FOREIGN_RENAMES = {
    "Age": "age_building",
    "No Stories": "count_floors_pre_eq",
    "PGA_max": "PGA_g",
    "Floor Area": "plinth_area_sq_ft",
    "Structural Damage (5-class)": "damage_grade",
}

# Constants given to every row of the foreign survey.
FOREIGN_CONSTANTS = {
    "foundation_type": 4,
    "roof_type": 2,
    "ground_floor_type": 4,
    "has_superstructure_mud_mortar_stone": 0,
    "has_superstructure_stone_flag": 0,
    "has_superstructure_cement_mortar_stone": 1,
    "has_superstructure_cement_mortar_brick": 1,
    "has_superstructure_timber": 0,
    "has_superstructure_bamboo": 0,
    "has_superstructure_other": 0,
}
ENGINEERED_MAX_AGE = 23

# Damage letters in order of grade, and the names shown in reports.
DAMAGE_LETTERS = {"N": 0, "L": 1, "M": 2, "S": 3, "C": 4}
GRADE_NAMES = ("Grade 1", "Grade 2", "Grade 3", "Grade 4", "Grade 5")

# Unit factors.
KM_PER_MILE = 1.60934
FEET_PER_METRE = 3.28084
SQ_FEET_PER_SQ_METRE = 10.7639


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns of a table are measures, 0/1 flags, categories and the target."""

    numeric: tuple[str, ...]
    flags: tuple[str, ...]
    categories: tuple[str, ...]
    target: str

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.flags + self.categories

    def validate(self, df: DataFrame) -> DataFrame:
        """Return ``df``; raise if a column of the spec is missing."""
        missing = [c for c in (*self.features, self.target) if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing from the table: {missing}")
        return df


SURVEY_FEATURES = FeatureSpec(NUMERIC_COLUMNS, FLAG_COLUMNS, CATEGORY_COLUMNS, TARGET_COLUMN)
