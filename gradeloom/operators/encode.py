"""Category codes: the rank of a value among the sorted distinct values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeloom.operators.impute import column_values
from gradeloom.operators.ranking import running_sums
from gradeloom.sources.shared import materialize


@dataclass(frozen=True)
class LabelEncoder:
    """Fit codes on one table and reuse them on any other.

    Codes start at ``start``. NULL and values that were not seen get ``unseen``. The defaults
    give codes from 0 with -1 for NULL; ``start=1, unseen=0`` reserves a slot for the unseen.
    """

    columns: tuple[str, ...]
    start: int = 0
    unseen: int = -1

    def fit(self, df: DataFrame) -> LabelEncoderModel:
        """One scan collects the distinct values of all columns into a stored table."""
        values = materialize(
            column_values(df, list(self.columns)).filter("v IS NOT NULL").distinct(), "categories"
        )
        kinds = dict(df.dtypes)
        return LabelEncoderModel(
            self,
            {
                c: self._dictionary(
                    values.filter(F.col("i") == i).selectExpr(f"cast(v AS {kinds[c]}) AS value")
                )
                for i, c in enumerate(self.columns)
            },
        )

    def _dictionary(self, values: DataFrame) -> DataFrame:
        """Codes in the order of the values, ranked by ranges and stored, whatever the number of values."""
        ranked = running_sums(values, [], "value", {"code": F.lit(1)})
        return materialize(
            ranked.select("value", (F.col("code") + self.start).cast("int").alias("code")), "codes"
        )


@dataclass(frozen=True)
class LabelEncoderModel:
    encoder: LabelEncoder
    dictionaries: dict[str, DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the values by codes.

        The dictionaries are stored tables of known size: small ones are broadcast by Catalyst,
        large ones are shuffled, where adaptive execution splits hot values.
        """
        columns = df.columns
        for i, (c, codes) in enumerate(self.dictionaries.items()):
            named = codes.select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
            df = df.join(named, F.col(f"`{c}`") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        position = {c: i for i, c in enumerate(self.dictionaries)}
        return df.select(
            *[
                F.coalesce(f"_c{position[c]}", F.lit(self.encoder.unseen)).alias(c)
                if c in position
                else F.col(f"`{c}`")
                for c in columns
            ]
        )
