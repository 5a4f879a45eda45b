"""Exact half-up rounding of ratios.

Rates, means and percentages are computed from integer totals (counts,
cents) with integral division, so the rounding is exact and does not depend
on floating-point order or on the engine's double rounding.  The result is
cast to DOUBLE only at the edge.  Division by zero gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ratio_round(num: str, den: str, scale: int = 2, mult: int = 1) -> Column:
    """round_half_up(mult * num / den, scale) as DOUBLE; NULL if den is 0.

    ``num`` and ``den`` name integral columns (counts, sums of ints, cents).
    Work is done in DECIMAL(38,0) so large totals cannot overflow.  The
    rounded value is exact; its DOUBLE form is the nearest double while the
    result has fewer than 16 significant digits (|result| * 10**scale < 2**53),
    far above any rate, mean or margin here.
    """
    n = f"cast({_q(num)} as decimal(38,0))"
    d = f"cast({_q(den)} as decimal(38,0))"
    factor = 2 * mult * 10 ** scale
    magnitude = f"(({factor} * abs({n}) + abs({d})) div (2 * abs({d})))"
    sign = f"(case when ({n} < 0) <> ({d} < 0) and {n} <> 0 then -1 else 1 end)"
    return F.expr(
        f"case when {d} = 0 then null "
        f"else cast({sign} * {magnitude} as double) / {10 ** scale} end"
    )


def rate_pct(late: str, total: str) -> Column:
    """ROUND(late * 100 / total, 2): the late-delivery rate in percent."""
    return ratio_round(late, total, 2, 100)


def cents(col: str | Column) -> Column:
    """A DECIMAL(...,2) money column as whole cents (exact)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c * 100).cast("decimal(38,0)")


def money(col: str | Column) -> Column:
    """ROUND(money, 2) cast to DOUBLE at the edge (money is DECIMAL(…,2))."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 2).cast("double")
