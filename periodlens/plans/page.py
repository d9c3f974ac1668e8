"""One page pass: every analysis the six tabs show, each computed once.

The reference issues 20 full-table statements per pass, 9 of them
different (SURVEY §3). Here the 9 are built as lazy plans over the same kept
fact and run as independent Spark jobs submitted from a small thread pool,
so their stages are scheduled side by side; cards, ranked lists and reports
then read the results instead of recomputing them.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Selection
from ..operators.reasons import with_reason
from ..operators.two_period import MEASURE_SOURCES, _value_sql, in_periods
from ..params import Periods
from ..schema import PERIOD, dim
from . import analyses as A

# Every page analysis keys on the product hierarchy (or on nothing).
PRODUCT_GRAIN = ("urun_kod", "urun_ad", "mal_grubu", "ust_mal", "urun_grubu")

PAGE_ANALYSES: dict[str, Callable[[DataFrame, Periods, Selection], DataFrame]] = {
    "ozet": A.kpi_summary,                                              # Q-1
    "mal_grubu": lambda f, p, s: with_reason(A.group_analysis(f, p, s)),        # Q-2
    "urun_grubu": lambda f, p, s: with_reason(A.product_group_analysis(f, p, s)),  # Q-4
    "urun": lambda f, p, s: with_reason(A.product_analysis(f, p, s)),          # Q-8
    "urun_adet": A.products_by_units,                                   # Q-11
    "urun_ciro": A.products_by_revenue,                                 # Q-13
    "marj_mal_grubu": A.group_margin,                                   # Q-19
    "marj_urun": A.product_margin,                                      # Q-20
    "marj_ozet": A.margin_kpi,                                          # Q-21
}


def grain_base(fact: DataFrame, periods: Periods, grain: tuple[str, ...],
               selection: Selection = Selection()) -> DataFrame:
    """The selected fact summed per ``grain`` and period, in the fact's own
    columns (signed measures as sums of ABS, so the analyses'
    ABS leaves them as they are). An analysis whose keys and labels are in the
    grain gives the same result on it as on the fact: its sums are sums of these
    partial sums, and the max of a label over distinct values is the max over
    rows. One partial + final aggregate."""
    src = in_periods(selection.apply(fact), periods)
    return src.groupBy(*[dim(c).alias(c) for c in grain], PERIOD).agg(
        *[F.expr(f"sum({_value_sql(name)})").alias(col)
          for name, (col, _) in MEASURE_SOURCES.items()])


def product_base(fact: DataFrame, periods: Periods,
                 selection: Selection = Selection()) -> DataFrame:
    """The base of every page analysis, report, margin reason and product list."""
    return grain_base(fact, periods, PRODUCT_GRAIN, selection)


def page(fact: DataFrame, periods: Periods, selection: Selection = Selection(),
         base: DataFrame | None = None) -> dict[str, DataFrame]:
    """The nine analyses as lazy DataFrames, over ``base`` (a product base
    of this fact and selection) when given."""
    if base is not None:
        fact, selection = base, Selection(min_ciro=selection.min_ciro)
    return {name: fn(fact, periods, selection) for name, fn in PAGE_ANALYSES.items()}


def run_page(fact: DataFrame, periods: Periods, sink: Callable[[str, DataFrame], object],
             selection: Selection = Selection(), parallel: int = 4,
             shared_base: bool = False,
             base: DataFrame | None = None) -> dict[str, object]:
    """Run every analysis of a pass through ``sink(name, df)`` (for example a
    write to a results folder), up to ``parallel`` jobs at a time. Returns
    what each sink call returned.

    With ``shared_base`` the fact is read and shuffled once, into the product
    base (kept MEMORY_AND_DISK for the pass, lineage-backed), and the nine
    analyses aggregate that instead of the fact: for a fact that is read from
    storage. By default each analysis aggregates the fact: for a fact that is
    kept in memory, where the base's extra job and shuffle cost more than the
    scans it saves. ``base``: a product base made before."""
    own = shared_base and base is None
    if own:
        base = product_base(fact, periods, selection).persist(StorageLevel.MEMORY_AND_DISK)
        base.count()
    sink = inheritable_thread_target(fact.sparkSession)(sink)
    try:
        plans = page(fact, periods, selection, base)
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            futures = {name: pool.submit(sink, name, df) for name, df in plans.items()}
            return {name: f.result() for name, f in futures.items()}
    finally:
        if own:
            base.unpersist()


def write_page(fact: DataFrame, periods: Periods, out: str,
               selection: Selection = Selection(), parallel: int = 4,
               base: DataFrame | None = None) -> dict[str, str]:
    """Write each analysis of a pass to ``<out>/<name>/`` (parquet)."""
    def sink(name, df):
        path = f"{out.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return path
    return run_page(fact, periods, sink, selection, parallel, base=base)
