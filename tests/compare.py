"""Compare a query's result with its SQL equivalent in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()

# Types that hold the same values in both engines.
SAME = {"int32": "int", "int64": "long", "string": "str", "large_string": "str", "double": "double", "bool": "bool"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _sorted_rows(table, names):
    rows = zip(*[table.column(n).to_pylist() for n in names])
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None if both results agree, else what differs."""
    left, right = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return f"columns {names} != {sorted(right.column_names)}"
    kinds = [(n, str(left.schema.field(n).type), str(right.schema.field(n).type)) for n in names]
    unlike = [k for k in kinds if SAME.get(k[1], k[1]) != SAME.get(k[2], k[2])]
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} != {right.num_rows}"
    for a, b in zip(_sorted_rows(left, names), _sorted_rows(right, names)):
        for n, x, y in zip(names, a, b):
            if x != y:
                if isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y):
                    continue
                return f"{n}: {x!r} != {y!r} in {dict(zip(names, a))} vs {dict(zip(names, b))}"
    return f"types {unlike}" if unlike else None
