"""Two-period conditional aggregation (AGG-1..7).

``SUM(CASE WHEN yil = p THEN m ELSE 0 END)`` for both periods in one pass
over the fact: one partial (map-side) hash aggregate, one shuffle on the key,
one final aggregate. Partial aggregation bounds what a hot key sends through
the shuffle to one row per map task. Not ``pivot``: that leaves null for a
period with no rows, where the reference gives 0.

Sums run in the input type (exact for decimal measures) and are cast to
double at the end, before any division.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Periods
from ..schema import PERIOD, dim

# Output measure name -> (fact column, summed as ABS). Waste, inventory
# difference and campaign loss are signed and always go through ABS per row
# before the sum (AGG-2, AGG-4).
MEASURE_SOURCES = {
    "adet": ("adet", False),
    "ciro": ("ciro", False),
    "marj": ("marj", False),
    "fire": ("fire", True),
    "envanter": ("envanter", True),
    "kampanya": ("kampanya_zarar", True),
}


def _value_sql(name: str) -> str:
    src, absolute = MEASURE_SOURCES[name]
    return f"abs(`{src}`)" if absolute else f"`{src}`"


def _case_sql(name: str, year: int, otherwise: str | None = "0") -> str:
    tail = f" ELSE {otherwise}" if otherwise is not None else ""
    return f"CASE WHEN `{PERIOD}` = {int(year)} THEN {_value_sql(name)}{tail} END"


# Expressions are written as SQL text over fixed identifiers and integer
# years (no user value is spliced in): one call per expression keeps plan
# construction cheap next to the many column-builder calls it replaces.

def exact_period_sum(name: str, year: int) -> Column:
    """``SUM(CASE WHEN yil = year THEN m ELSE 0 END)`` in the input type."""
    return F.expr(f"sum({_case_sql(name, year)})")


def period_sum(name: str, year: int) -> Column:
    """AGG-3/4: ``SUM(CASE WHEN yil = year THEN m ELSE 0 END)`` as double.
    The sum itself runs in the input type (exact for decimals)."""
    return F.expr(f"CAST(sum({_case_sql(name, year)}) AS DOUBLE)")


def in_periods(fact: DataFrame, periods: Periods) -> DataFrame:
    """Keep the two periods only; on a ``partitionBy('yil')`` source this is
    partition pruning, a third year never reaches the sums (E16)."""
    return fact.where(f"`{PERIOD}` IN ({int(periods.prev)}, {int(periods.cur)})")


def _sum_columns(measures: Sequence[str], periods: Periods,
                 cur_only: Sequence[str]) -> list[tuple[str, str, int]]:
    cols = []
    for m in measures:
        cols += [(f"{m}_prev", m, periods.prev), (f"{m}_cur", m, periods.cur)]
    cols += [(f"{m}_cur", m, periods.cur) for m in cur_only]
    return cols


def two_period(fact: DataFrame, keys: str | Sequence[str], labels: Sequence[str],
               measures: Sequence[str], periods: Periods,
               cur_only: Sequence[str] = (), label_fold: str = "hash") -> DataFrame:
    """Key(s), ``max(label)`` (AGG-5), ``<m>_prev`` and ``<m>_cur`` for each
    measure, ``<m>_cur`` only for ``cur_only``.

    ``max`` over a string has no fixed-width buffer, so an aggregate holding
    it is planned as a sort-based aggregate, which sorts its input rows in
    every map task. Two forms, equal in result (sums of partial sums; the max
    over distinct labels is the max over rows):

    - ``label_fold="hash"``: the sums run as a hash aggregate grouped by
      (keys, labels); the labels are folded with ``max`` in a second aggregate
      over those key-grain rows. For a key much coarser than the fact (groups,
      product groups, products, stores) the second exchange is small and the
      pass over the fact never sorts.
    - ``label_fold="sort"``: one aggregate, one exchange. For keys nearly as
      fine as the fact (a parent and a store, a product and a store) the hash
      form would shuffle almost every row twice; one sort-based pass is
      cheaper there."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = _sum_columns(measures, periods, cur_only)
    src = in_periods(fact, periods)
    by = [dim(k).alias(k) for k in keys]
    if not labels or label_fold == "sort":
        return src.groupBy(*by).agg(
            *[F.expr(f"max(coalesce(`{lbl}`, ''))").alias(lbl) for lbl in labels],
            *[period_sum(m, y).alias(n) for n, m, y in cols])
    if label_fold != "hash":
        raise ValueError(f"label_fold must be 'hash' or 'sort', not {label_fold!r}")
    exact = [exact_period_sum(m, y).alias(n) for n, m, y in cols]
    partial = src.groupBy(*by, *[dim(lbl).alias(lbl) for lbl in labels]).agg(*exact)
    return partial.groupBy(*keys).agg(
        *[F.expr(f"max(`{lbl}`)").alias(lbl) for lbl in labels],
        *[F.expr(f"CAST(sum(`{n}`) AS DOUBLE)").alias(n) for n, _, _ in cols])


def period_totals(fact: DataFrame, measures: Sequence[str], periods: Periods) -> DataFrame:
    """AGG-7: grand total per period spread to one wide row; a period with
    no rows, or only null values, gives 0. A global aggregate: each task
    sends one partial row, the final step merges them."""
    aggs = []
    for m in measures:
        for tag, year in (("prev", periods.prev), ("cur", periods.cur)):
            case = _case_sql(m, year, otherwise=None)
            aggs.append(F.expr(f"coalesce(CAST(sum({case}) AS DOUBLE), CAST(0 AS DOUBLE))")
                        .alias(f"{m}_{tag}"))
    return in_periods(fact, periods).agg(*aggs)
