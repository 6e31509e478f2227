"""Survey files: CSV with and without locale, header reads, sinks."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from gradeloom.functions.text import text as literal


def _decimal_comma(text: Column, to: DataType, permissive: bool) -> Column:
    number = F.replace(text, F.lit(","), F.lit("."))
    return number.try_cast(to) if permissive else number.cast(to)


def _typed(raw: DataFrame, schema: StructType, permissive: bool) -> DataFrame:
    """Cast text columns to ``schema``; numbers are written with a decimal comma."""
    return raw.select(
        *[
            F.col(f"`{f.name}`")
            if isinstance(f.dataType, StringType)
            else _decimal_comma(F.col(f"`{f.name}`"), f.dataType, permissive).alias(f.name)
            for f in schema
        ]
    )


def _as_text(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType()) for f in schema])


def read_locale_csv(
    spark: SparkSession, path: str, schema: StructType, sep: str = ";", permissive: bool = False
) -> DataFrame:
    """CSV with a header, ``sep`` between fields and a decimal comma in numbers.

    Numbers are parsed from text, so every double is read exactly. A malformed number is an error;
    with ``permissive`` it becomes NULL.
    """
    raw = (
        spark.read.schema(_as_text(schema))
        .option("mode", "FAILFAST")
        .csv(path, sep=sep, header=True)
    )
    return _typed(raw, schema, permissive)


def read_csv_skipping_lines(
    spark: SparkSession,
    path: str,
    schema: StructType,
    skip_lines: tuple[int, ...] = (0, 2),
    sep: str = ";",
    permissive: bool = True,
) -> DataFrame:
    """Locale CSV whose physical lines ``skip_lines`` (title, units) are no data.

    The first line that is not skipped is the header. The preamble, a handful of lines, is read once.
    Files are scanned in splits as usual; of the lines that equal one of the preamble only the first of
    each file are dropped, so data rows of the same text stay. All files under ``path`` must open with
    the same preamble.
    Columns are found by header name, so the file may hold more of them than ``schema``.
    """
    n_lines = max(skip_lines, default=-1) + 1
    header_at = next(i for i in range(n_lines + 1) if i not in skip_lines)
    n_lines = max(n_lines, header_at + 1)
    preamble = [r.value for r in spark.read.text(path).limit(n_lines).collect()]
    names = [name.strip().strip('"') for name in preamble[header_at].split(sep)]
    unknown = [f.name for f in schema if f.name not in names]
    if unknown:
        raise ValueError(f"columns missing from the header: {unknown}")
    # How often each line opens a file: so many of its first equal lines are dropped, and no others.
    opening = Counter(preamble[i] for i in {*skip_lines, header_at} if i < len(preamble))
    alike = F.col("value").isin(list(opening))
    # Only lines that equal one of the preamble are numbered; lines of a file keep their order in ``_at``
    # within a split, and splits are ordered by where they begin.
    block = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    first = Window.partitionBy("_file", "value").orderBy("_block", "_at")
    drops = "CASE value " + " ".join(f"WHEN {literal(v)} THEN {n}" for v, n in opening.items()) + " END"
    kept = block.filter(alike).withColumn("_n", F.row_number().over(first)).filter(f"_n > {drops}").select("value")
    lines = block.filter(~alike).select("value").unionByName(kept)
    parsed = F.from_csv("value", _ddl(names), {"sep": sep})
    raw = lines.select(parsed.alias("r")).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema])
    return _typed(raw, schema, permissive)


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{name}` STRING" for name in names)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Plain CSV with a header; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line; the body is not scanned."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header in every part file, readable by :func:`read_csv`."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_locale_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """CSV with a decimal comma in floating-point columns."""
    as_text = [
        F.replace(F.col(f"`{name}`").cast("string"), F.lit("."), F.lit(",")).alias(name)
        if kind in ("double", "float")
        else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    write_csv(df.select(*as_text), path, sep)
