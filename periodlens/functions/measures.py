"""Derived-column expressions (DRV-1..10). All are native Column
expressions: guarded before dividing (ANSI mode raises on x/0) and kept
inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nz(x) -> Column:
    """DRV-6: null -> 0."""
    return F.coalesce(_c(x), F.lit(0.0))


def _names(*xs) -> bool:
    return all(isinstance(x, str) for x in xs)


# With column names the expressions are built as one SQL expression each
# (fixed identifiers, numeric constants only): the same plan, far fewer
# driver-to-JVM calls while the plan is built.

def pct_change(prev, cur, no_base: float = 0.0) -> Column:
    """DRV-1 / DRV-2: ``(cur/prev - 1) * 100`` when prev > 0, else ``no_base``
    (0 in the analyses, 100 in the riser lists)."""
    if _names(prev, cur):
        return F.expr(f"CASE WHEN `{prev}` > 0 THEN (`{cur}` / `{prev}` - 1) * 100 "
                      f"ELSE CAST({float(no_base)!r} AS DOUBLE) END")
    prev, cur = _c(prev), _c(cur)
    return F.when(prev > 0, (cur / prev - 1) * 100).otherwise(F.lit(float(no_base)))


def diff(prev, cur) -> Column:
    """DRV-3: ``cur - prev``."""
    if _names(prev, cur):
        return F.expr(f"`{cur}` - `{prev}`")
    return _c(cur) - _c(prev)


def ratio_pct(num, den) -> Column:
    """DRV-4: ``num/den*100`` when den > 0, else 0 (margin ratio)."""
    if _names(num, den):
        return F.expr(f"CASE WHEN `{den}` > 0 THEN `{num}` / `{den}` * 100 "
                      f"ELSE CAST(0.0 AS DOUBLE) END")
    num, den = _c(num), _c(den)
    return F.when(den > 0, num / den * 100).otherwise(F.lit(0.0))


def kpi_polarity(deg, inverse: bool) -> Column:
    """DRV-8: a rise is good for units, revenue and margin, bad for waste
    (``inverse``). At 0 a normal measure reads 'down', waste 'up'."""
    return F.when((_c(deg) > 0) == F.lit(inverse), F.lit("down")).otherwise(F.lit("up"))


def direction3(x) -> Column:
    """DRV-9: up / down / flat."""
    x = _c(x)
    return F.when(x > 0, F.lit("up")).when(x < 0, F.lit("down")).otherwise(F.lit("flat"))


def direction2(x) -> Column:
    """DRV-10: up when > 0, else down."""
    return F.when(_c(x) > 0, F.lit("up")).otherwise(F.lit("down"))
