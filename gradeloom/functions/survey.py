"""Column expressions for preparing survey tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.spec import DAMAGE_LETTERS, FEET_PER_METRE, KM_PER_MILE, SQ_FEET_PER_SQ_METRE


def miles_to_km(c: Column) -> Column:
    return c * F.lit(KM_PER_MILE)


def metres_to_feet(c: Column) -> Column:
    return c * F.lit(FEET_PER_METRE)


def sq_metres_to_sq_feet(c: Column) -> Column:
    return c * F.lit(SQ_FEET_PER_SQ_METRE)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL where ``b`` is zero, to be imputed later."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def damage_class(letter: Column, letters: dict[str, int] = DAMAGE_LETTERS) -> Column:
    """Ordinal class of a damage letter; NULL for any other text."""
    chain = F
    for text, code in letters.items():
        chain = chain.when(letter == text, F.lit(code))
    return chain


def above(c: Column, bound: float) -> Column:
    """1 if ``c > bound``, else 0; NULL counts as not above."""
    return F.coalesce(c > bound, F.lit(False)).cast("int")


def at_most(c: Column, bound: float) -> Column:
    """1 if ``c <= bound``, else 0; NULL counts as not within."""
    return F.coalesce(c <= bound, F.lit(False)).cast("int")


def drop_at(df: DataFrame, ordinal: int) -> DataFrame:
    """Drop the column at position ``ordinal``."""
    return df.drop(df.columns[ordinal])


def align_columns(df: DataFrame, order: list[str], last: str | None = None) -> DataFrame:
    """Columns in the order of another table's header, extra ones after, ``last`` at the end."""
    body = [c for c in df.columns if c != last]
    ordered = [c for c in order if c in body]
    ordered += [c for c in body if c not in ordered]
    return df.select(*[F.col(f"`{c}`") for c in ordered + ([last] if last else [])])


def zero_base(df: DataFrame, target: str) -> DataFrame:
    """Shift classes that start at 1 down to 0; leave zero-based ones alone.

    One aggregate decides, so a Parquet source answers from its footers.
    """
    lowest = df.agg(F.min(target)).first()[0]
    return df.withColumn(target, F.col(target) - 1) if lowest == 1 else df
