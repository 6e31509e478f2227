"""Building blocks of SQL expressions as text.

Unrolled expressions hold hundreds of terms. As text they reach Spark in one ``F.expr`` call; built
from ``Column`` objects each operator would be a call into the JVM of several milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterable


def name(column: str) -> str:
    """Quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def number(x: float) -> str:
    """Double literal with all digits."""
    return f"{float(x)!r}D"


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def total(parts: Iterable[str]) -> str:
    """Left-to-right sum."""
    return f"({' + '.join(parts)})"


def array(parts: Iterable[str]) -> str:
    return f"array({', '.join(parts)})"


def slots(vector: str, n: int) -> list[str]:
    """The first ``n`` elements; a shorter array is an error at run time."""
    return [f"{vector}[{k}]" for k in range(n)]


def largest(parts: list[str]) -> str:
    return f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0]


def pick(y: str, values: list[str]) -> str:
    """The value at position ``y``; NULL outside."""
    return f"CASE {y} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def clipped(c: str, low: float | None = None, high: float | None = None) -> str:
    """``c`` kept within bounds. NULL stays NULL, which ``greatest`` and ``least`` would hide."""
    below = f"WHEN {c} < {number(low)} THEN {number(low)} " if low is not None else ""
    above = f"WHEN {c} > {number(high)} THEN {number(high)} " if high is not None else ""
    return f"CASE {below}{above}ELSE {c} END"
