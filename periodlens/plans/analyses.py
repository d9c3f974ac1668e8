"""The page analyses (Q-1, Q-2, Q-4, Q-8, Q-11, Q-13, Q-19, Q-20, Q-21).

Every analysis is one lazy plan: selection predicate (pushed to the scan) ->
non-empty key -> two-period conditional sums by the key (partial aggregate,
one shuffle on the key, final aggregate) -> HAVING -> derived columns. Lists
of the best and worst rows are ``top_n`` on the result (TakeOrderedAndProject).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import diff, kpi_polarity, pct_change, ratio_pct
from ..functions.text import fixed, money, thousands
from ..operators.filters import Selection, non_empty
from ..operators.ranking import top_n
from ..operators.two_period import in_periods, period_totals, two_period
from ..params import Periods
from ..schema import PERIOD

BASIC = ("adet", "ciro", "marj", "fire")
MARGIN = ("marj", "ciro", "adet", "fire", "envanter", "kampanya")


@dataclass(frozen=True)
class AnalysisSpec:
    key: str
    labels: tuple[str, ...]
    measures: tuple[str, ...]
    # FLT-11: HAVING ciro_cur >= min_ciro / divisor when min_ciro > 0.
    floor_divisor: float | None = None
    deg: tuple[str, ...] = ()          # DRV-1 percent changes
    margin: bool = False               # marj_fark, marj_deg, margin ratios
    oran_fark: bool = False            # DRV-5 ratio change in points
    having: Callable[[], Column] | None = None


SPECS = {
    # Q-2 merchandise group
    "mal_grubu": AnalysisSpec("mal_grubu", ("ust_mal",), BASIC, 1.0, BASIC),
    # Q-4 product group
    "urun_grubu": AnalysisSpec("urun_grubu", (), BASIC, 1.0, BASIC),
    # Q-8 product; the floor is a fifth of the group floor
    "urun": AnalysisSpec("urun_kod", ("urun_ad", "mal_grubu", "ust_mal", "urun_grubu"),
                         BASIC, 5.0, BASIC),
    # Q-11 products by units
    "urun_adet": AnalysisSpec("urun_kod", ("urun_ad", "mal_grubu", "urun_grubu"),
                              ("adet", "ciro", "marj"), None, ("adet", "ciro")),
    # Q-13 products by revenue (FLT-15)
    "urun_ciro": AnalysisSpec("urun_kod", ("urun_ad", "mal_grubu", "urun_grubu"),
                              ("adet", "ciro", "marj"), None, ("adet", "ciro"),
                              having=lambda: F.col("ciro_cur") > 0),
    # Q-19 margin by merchandise group
    "marj_mal_grubu": AnalysisSpec("mal_grubu", ("ust_mal",), MARGIN, 1.0,
                                   margin=True, oran_fark=True),
    # Q-20 margin by product; a tenth of the floor, no ratio change
    "marj_urun": AnalysisSpec("urun_kod", ("urun_ad", "mal_grubu"), MARGIN, 10.0,
                              margin=True),
}


def margin_columns(oran_fark: bool) -> list[Column]:
    """DRV-3..5 on margin: difference, % change, margin ratio per period and
    (optionally) the ratio change in points."""
    cols = [diff("marj_prev", "marj_cur").alias("marj_fark"),
            pct_change("marj_prev", "marj_cur").alias("marj_deg"),
            ratio_pct("marj_prev", "ciro_prev").alias("marj_oran_prev"),
            ratio_pct("marj_cur", "ciro_cur").alias("marj_oran_cur")]
    if oran_fark:
        cols.append(F.expr(
            "CASE WHEN ciro_cur > 0 THEN marj_cur / ciro_cur * 100 ELSE CAST(0.0 AS DOUBLE) END"
            " - CASE WHEN ciro_prev > 0 THEN marj_prev / ciro_prev * 100"
            " ELSE CAST(0.0 AS DOUBLE) END").alias("marj_oran_fark"))
    return cols


def add_margin_columns(df: DataFrame, oran_fark: bool) -> DataFrame:
    return df.select("*", *margin_columns(oran_fark))


def analyze(fact: DataFrame, spec: AnalysisSpec, periods: Periods,
            selection: Selection = Selection(), min_adet: float = 0) -> DataFrame:
    df = non_empty(selection.apply(fact), spec.key)
    out = two_period(df, spec.key, spec.labels, spec.measures, periods)
    floor = selection.min_ciro or 0
    if spec.floor_divisor and floor > 0:
        out = out.where(F.col("ciro_cur") >= F.lit(float(floor) / spec.floor_divisor))
    if min_adet and min_adet > 0:  # FLT-12
        out = out.where(F.col("adet_cur") >= F.lit(float(min_adet)))
    if spec.having is not None:
        out = out.where(spec.having())
    derived = [pct_change(f"{m}_prev", f"{m}_cur").alias(f"{m}_deg") for m in spec.deg]
    if spec.margin:
        derived += margin_columns(spec.oran_fark)
    return out.select("*", *derived) if derived else out


# --- named analyses --------------------------------------------------------

def group_analysis(fact, periods, selection=Selection()) -> DataFrame:
    """Q-2."""
    return analyze(fact, SPECS["mal_grubu"], periods, selection)


def product_group_analysis(fact, periods, selection=Selection()) -> DataFrame:
    """Q-4."""
    return analyze(fact, SPECS["urun_grubu"], periods, selection)


def product_analysis(fact, periods, selection=Selection()) -> DataFrame:
    """Q-8."""
    return analyze(fact, SPECS["urun"], periods, selection)


def products_by_units(fact, periods, selection=Selection(), min_adet: float = 0) -> DataFrame:
    """Q-11 (FLT-12 units floor, 0 = none)."""
    return analyze(fact, SPECS["urun_adet"], periods, selection, min_adet=min_adet)


def products_by_revenue(fact, periods, selection=Selection()) -> DataFrame:
    """Q-13."""
    return analyze(fact, SPECS["urun_ciro"], periods, selection)


def group_margin(fact, periods, selection=Selection()) -> DataFrame:
    """Q-19."""
    return analyze(fact, SPECS["marj_mal_grubu"], periods, selection)


def product_margin(fact, periods, selection=Selection()) -> DataFrame:
    """Q-20."""
    return analyze(fact, SPECS["marj_urun"], periods, selection)


# --- ranked lists on an analysis result --------------------------------------

def worst(df: DataFrame, key: str, n: int, by: str = "adet_deg") -> DataFrame:
    """TOP-1..3, TOP-6/7 (loss side): smallest first, ties by key."""
    return top_n(df, by, n, largest=False, tie=[key])


def best(df: DataFrame, key: str, n: int, by: str = "adet_deg") -> DataFrame:
    return top_n(df, by, n, largest=True, tie=[key])


def most(df: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """TOP-4/5 (most)."""
    return top_n(df, by, n, largest=True, tie=[key])


def least(df: DataFrame, key: str, by: str, n: int, positive_only: bool = True) -> DataFrame:
    """TOP-4/5 (least); FLT-17 keeps positive values only."""
    src = df.where(F.col(by) > 0) if positive_only else df
    return top_n(src, by, n, largest=False, tie=[key])


# --- KPIs --------------------------------------------------------------------

KPI_MEASURES = ("adet", "ciro", "marj", "fire")
KPI_INVERSE = {"adet": False, "ciro": False, "marj": False, "fire": True}


def kpi_summary(fact: DataFrame, periods: Periods, selection=Selection()) -> DataFrame:
    """Q-1: one row, totals per period (missing -> 0) and % change."""
    out = period_totals(selection.apply(fact), KPI_MEASURES, periods)
    return out.select("*", *[pct_change(f"{m}_prev", f"{m}_cur").alias(f"{m}_degisim")
                             for m in KPI_MEASURES])


def kpi_trend(fact: DataFrame, periods: Periods, selection=Selection()) -> DataFrame:
    """Q-1 as cards: one row per measure with current value, change, the
    DRV-8 direction (rise good, except waste) and the card texts (value
    ``{:,.0f}``, money with the currency sign; change with '+' only above 0)."""
    s = kpi_summary(fact, periods, selection)

    def card(i, m):
        deger, deg = F.col(f"{m}_cur"), F.col(f"{m}_degisim")
        value = thousands(deger) if m == "adet" else money(deger)
        change = F.concat(F.when(deg > 0, F.lit("+")).otherwise(F.lit("")), fixed(deg, 1),
                          F.lit("%"))
        return F.struct(F.lit(i + 1).alias("sira"), F.lit(m).alias("metrik"),
                        deger.alias("deger"), deg.alias("degisim"),
                        kpi_polarity(deg, KPI_INVERSE[m]).alias("yon"),
                        value.alias("deger_metin"), change.alias("degisim_metin"))
    rows = F.explode(F.array(*[card(i, m) for i, m in enumerate(KPI_MEASURES)]))
    return s.select(rows.alias("k")).select("k.*")


def totals_by_period(fact: DataFrame, periods: Periods, selection=Selection(),
                     measures=KPI_MEASURES) -> DataFrame:
    """AGG-1/2 as the reference's statements return them: one row per period
    with ``SUM(m)`` (``SUM(ABS(m))`` for the signed measures)."""
    from ..operators.two_period import _value_sql
    src = in_periods(selection.apply(fact), periods)
    return src.groupBy(PERIOD).agg(*[F.expr(f"CAST(sum({_value_sql(m)}) AS DOUBLE)").alias(m)
                                     for m in measures])


def margin_kpi(fact: DataFrame, periods: Periods, selection=Selection()) -> DataFrame:
    """Q-21: margin and revenue per period, difference, % change, ratios and
    the ratio change in points."""
    out = period_totals(selection.apply(fact), ("marj", "ciro"), periods)
    return (add_margin_columns(out, oran_fark=True))
