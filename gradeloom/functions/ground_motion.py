"""Median peak ground acceleration of Boore, Stewart, Seyhan and Atkinson (2014), without basin term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from gradeloom.functions.text import clipped, number

# PGA coefficients of the published model.
E_BY_MECHANISM = {"unspecified": 0.4473, "strike_slip": 0.4856, "normal": 0.2459, "reverse": 0.4539}
E4, E5, E6, M_HINGE = 1.431, 0.05053, -0.1662, 5.5
C1, C2, C3 = -1.134, 0.1917, -0.008088
M_REF, R_REF, H_KM = 4.5, 1.0, 4.5
SITE_C, VS30_CUT, VS30_REF = -0.6, 1500.0, 760.0
F1, F3, F4, F5 = 0.0, 0.1, -0.15, -0.00701
VS30_NONLINEAR_BASE = 360.0


@dataclass(frozen=True)
class Event:
    """Earthquake and site values shared by all rows; the defaults are those of the home survey."""

    magnitude: float = 7.8
    rake: float = 108.0
    vs30: float = 250.0


def e_of_rake(rake: str) -> str:
    """``e`` coefficient by style of faulting: within 30 degrees of 0 or 180 strike-slip."""
    e = {style: number(value) for style, value in E_BY_MECHANISM.items()}
    return (
        f"CASE WHEN abs({rake}) <= 30 OR abs({rake}) >= 150 THEN {e['strike_slip']}"
        f" WHEN {rake} > 0 THEN {e['reverse']} ELSE {e['normal']} END"
    )


def ln_pga_rock(rjb_km: str, magnitude: str, rake: str) -> str:
    """Source plus path term: ln PGA on reference rock."""
    over = f"({magnitude} - {number(M_HINGE)})"
    low = f"{number(E4)} * {over} + {number(E5)} * {over} * {over}"
    source = f"({e_of_rake(rake)}) + CASE WHEN {over} <= 0 THEN {low} ELSE {number(E6)} * {over} END"
    r = f"sqrt({rjb_km} * {rjb_km} + {number(H_KM * H_KM)})"
    spreading = f"({number(C1)} + {number(C2)} * ({magnitude} - {number(M_REF)}))"
    return (
        f"({source} + {spreading} * ln({r} / {number(R_REF)})"
        f" + {number(C3)} * ({r} - {number(R_REF)}))"
    )


def site_term(ln_rock: str, vs30: str) -> str:
    """Linear plus nonlinear amplification of the site."""
    linear = f"{number(SITE_C)} * ln(({clipped(vs30, high=VS30_CUT)}) / {number(VS30_REF)})"
    soft = f"exp({number(F5)} * (({clipped(vs30, high=VS30_REF)}) - {number(VS30_NONLINEAR_BASE)}))"
    rock = f"exp({number(F5 * (VS30_REF - VS30_NONLINEAR_BASE))})"
    slope = f"{number(F4)} * ({soft} - {rock})"
    shaking = f"ln((exp({ln_rock}) + {number(F3)}) / {number(F3)})"
    return f"({linear} + {number(F1)} + {slope} * {shaking})"


def pga_g(
    distance_km: str,
    magnitude: str | None = None,
    rake: str | None = None,
    vs30: str | None = None,
    event: Event = Event(),
) -> Column:
    """PGA in g at an epicentral distance, taken as the Joyner-Boore distance.

    Arguments are column names or SQL expressions. Event and site values may be columns, so one job
    serves many earthquakes. The expression is plain arithmetic inside code generation; no lookup per
    distinct distance is needed.
    """
    rock = ln_pga_rock(
        f"({distance_km})",
        f"({magnitude or number(event.magnitude)})",
        f"({rake or number(event.rake)})",
    )
    return F.expr(f"exp({rock} + {site_term(rock, f'({vs30 or number(event.vs30)})')})")
