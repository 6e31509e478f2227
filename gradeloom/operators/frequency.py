"""Smoothed class frequencies per category: a base learner that is one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.probability import uniform
from gradeloom.functions.text import array, name, number, total
from gradeloom.sources.shared import materialize


def _probs(n_classes: int) -> str:
    """Smoothed shares from the count columns n0.."""
    n = f"({total(f'n{c}' for c in range(n_classes))} + {number(n_classes)})"
    return array(f"(n{c} + 1.0D) / {n}" for c in range(n_classes))


@dataclass(frozen=True)
class FrequencyLearner:
    """One model per key column: ``P(y=c | key) = (n(key,c) + 1) / (n(key) + C)``.

    ``keys`` maps the name of a model to its key column. The counts of all models come from one scan
    with grouping sets and map-side aggregation, so a value held by a third of the rows costs no
    more than any other.
    """

    keys: dict[str, str]
    n_classes: int
    target: str = "y"

    def _counts(self, df: DataFrame, fold: str | None) -> DataFrame:
        names = [f"k{i}" for i in range(len(self.keys))]
        rows = df.selectExpr(
            *[f"{name(c)} AS {k}" for k, c in zip(names, self.keys.values())],
            f"{name(self.target)} AS y",
            *([f"{name(fold)} AS fold"] if fold else []),
        )
        extra = ["fold"] if fold else []
        counts = rows.groupingSets([[k, *extra] for k in names], *names, *extra).agg(
            F.grouping_id().alias("g"),
            *[F.expr(f"count_if(y = {c}) AS n{c}") for c in range(self.n_classes)],
        )
        return materialize(counts, "frequencies")

    def _model_counts(self, counts: DataFrame, i: int, folded: bool) -> DataFrame:
        """Counts of the i-th model out of the grouping sets."""
        last = len(self.keys) - 1
        key_bits = ((1 << len(self.keys)) - 1) ^ (1 << (last - i))
        return counts.filter(F.col("g") == (key_bits << 1 if folded else key_bits))

    def out_of_fold(self, df: DataFrame, fold: str = "fold") -> DataFrame:
        """Add a probability array per model, each row scored by counts of the other folds.

        The counts of all folds are kept per (key, fold); total minus own fold replaces one fit per fold.
        """
        counts = self._counts(df, fold)
        for i, (model, column) in enumerate(self.keys.items()):
            others = [
                f"sum(n{c}) OVER (PARTITION BY k{i}) - n{c} AS n{c}" for c in range(self.n_classes)
            ]
            table = (
                self._model_counts(counts, i, True)
                .selectExpr(f"k{i} AS _key", "fold AS _fold", *others)
                .selectExpr("_key", "_fold", f"{_probs(self.n_classes)} AS {name(model)}")
            )
            df = df.join(
                table,
                F.col(f"`{column}`").eqNullSafe(F.col("_key")) & (F.col(fold) == F.col("_fold")),
                "left",
            ).drop("_key", "_fold")
        return df

    def fit(self, df: DataFrame) -> FrequencyModel:
        counts = self._counts(df, None)
        tables = {
            model: self._model_counts(counts, i, False).selectExpr(
                f"k{i} AS _key", f"{_probs(self.n_classes)} AS {name(model)}"
            )
            for i, model in enumerate(self.keys)
        }
        return FrequencyModel(self, tables)


@dataclass(frozen=True)
class FrequencyModel:
    learner: FrequencyLearner
    tables: dict[str, DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add a probability array per model; a key never seen gets the uniform distribution."""
        columns = df.columns
        for model, table in self.tables.items():
            key = F.col(f"`{self.learner.keys[model]}`")
            df = df.join(table, key.eqNullSafe(F.col("_key")), "left").drop("_key")
        unseen = uniform(self.learner.n_classes)
        return df.selectExpr(
            *[name(c) for c in columns],
            *[f"coalesce({name(m)}, {unseen}) AS {name(m)}" for m in self.tables],
        )
