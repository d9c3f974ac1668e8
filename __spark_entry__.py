"""

Every query builds the sales fact from the given TPC-H-like tables
(``periodlens.sources.fixture_fact``, FIXTURES.md §2) and runs one analysis
of the library over all of it. ``oracle_sql()`` holds the same analysis as
DuckDB SQL over the same tables.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from oracle import duckdb_sql as O  # noqa: E402
from periodlens.functions import direction2, direction3, short_label  # noqa: E402
from periodlens.operators import Selection  # noqa: E402
from periodlens.operators import options as opt  # noqa: E402
from periodlens.operators.reasons import margin_reasons, with_reason  # noqa: E402
from periodlens.plans import analyses as A  # noqa: E402
from periodlens.plans import drilldown as D  # noqa: E402
from periodlens.plans import reports as R  # noqa: E402
from periodlens.sources import FIXTURE_PERIODS as P  # noqa: E402
from periodlens.sources import (fixture_fact, period_counts, register,  # noqa: E402
                                stack_periods)

SMOKE_DIR = "/root/testdata/sf0.001"

# Drill-down keys and filters present at sf0.001, 0.01 and 0.1.
MG, UG, UK, UST, BS = "PROMO/red widget", "PROMO", "1", "PROMO/widget", "NATION_12"
ALL = Selection()
ASIA = Selection(sm="ASIA")
ASIA_N2 = Selection(sm="ASIA", nitelik="N2")
NOWHERE = Selection(sm="NO SUCH REGION")
NO_FLOOR = Selection(min_ciro=0)
MIN_ADET = 150

_SPARK: dict[str, Callable[[DataFrame], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _reg(name: str, sql: str | tuple[str, str] | None):
    def deco(fn):
        _SPARK[name] = fn
        if sql is not None:
            _SQL[name] = O.with_fact(sql) if isinstance(sql, str) else O.with_fact(sql[1], sql[0])
        return fn
    return deco


def _eq(**kv):
    return O.sel_eq(**kv)


# --- sources, options ------------------------------------------------------------

_reg("period_counts", "SELECT yil, count(*) AS satir FROM veri GROUP BY yil")(
    lambda f: period_counts(f))

_SUMS = ", ".join(f"CAST(SUM({m}) AS DOUBLE) AS {m}" for m in ("adet", "ciro", "marj"))
_BY_PERIOD = f"SELECT yil, sm, count(*) AS satir, {_SUMS} FROM veri GROUP BY yil, sm"


def _from_period_frames(f: DataFrame) -> DataFrame:
    """The fact as one frame per period, as period files come: columns in capitals and
    another order, one with and one without the period column."""
    frames = {}
    for year, keep in ((P.prev, True), (P.cur, False)):
        part = f.where(F.col("yil") == year)
        part = part if keep else part.drop("yil")
        frames[year] = part.select(*[F.col(c).alias(c.title()) for c in reversed(part.columns)])
    return stack_periods(frames)


_reg("fact_from_period_files", _BY_PERIOD)(
    lambda f: _from_period_frames(f).groupBy("yil", "sm").agg(
        F.count(F.lit(1)).alias("satir"),
        *[F.sum(m).cast("double").alias(m) for m in ("adet", "ciro", "marj")]))
_reg("veri_view_sql", _BY_PERIOD)(
    lambda f: register(f, "veri").sparkSession.sql(_BY_PERIOD))

for _c in ("sm", "nitelik", "urun_grubu"):
    _reg(f"options_{_c}", f"SELECT DISTINCT {_c} FROM veri WHERE {_c} <> ''")(
        lambda f, c=_c: opt.distinct_values(f, c))

for _name, _parent, _child in (("options_bs_by_sm", "sm", "bs"),
                               ("options_ust_by_urun_grubu", "urun_grubu", "ust_mal"),
                               ("options_mal_by_ust", "ust_mal", "mal_grubu")):
    _reg(_name, f"SELECT DISTINCT {_parent}, {_child} FROM veri WHERE {_child} <> ''")(
        lambda f, p=_parent, c=_child: opt.child_pairs(f, p, c))

_reg("options_store_by_bs",
     "SELECT DISTINCT bs, magaza_kod, magaza_ad, concat_ws(' - ', magaza_kod, magaza_ad) "
     "AS etiket FROM veri WHERE magaza_kod <> ''")(lambda f: opt.store_options(f))
_reg("options_children_all", "SELECT DISTINCT mal_grubu FROM veri WHERE mal_grubu <> ''")(
    lambda f: opt.children(f, "mal_grubu"))
_reg("options_children_of",
     f"SELECT DISTINCT mal_grubu FROM veri WHERE mal_grubu <> '' AND ust_mal = {O.q(UST)}")(
    lambda f: opt.children(f, "mal_grubu", UST))
_reg("options_bs_of_sm", "SELECT DISTINCT bs FROM veri WHERE bs <> '' AND sm = 'ASIA'")(
    lambda f: opt.children(f, "bs", "ASIA"))
_reg("store_labels",
     "SELECT *, split_part(etiket, ' - ', 1) AS secili_kod FROM (SELECT DISTINCT bs, "
     "magaza_kod, magaza_ad, concat_ws(' - ', magaza_kod, magaza_ad) AS etiket FROM veri "
     f"WHERE magaza_kod <> '' AND bs = {O.q(BS)}) s")(
    lambda f: opt.code_of(opt.stores_of(f, BS)))

# --- KPIs ------------------------------------------------------------------------

_reg("kpi_summary", O.kpi_summary())(lambda f: A.kpi_summary(f, P))
_reg("kpi_summary_filtered", O.kpi_summary(_eq(sm="ASIA")))(
    lambda f: A.kpi_summary(f, P, ASIA))
_reg("kpi_summary_filtered2", O.kpi_summary(_eq(sm="ASIA", nitelik="N2")))(
    lambda f: A.kpi_summary(f, P, ASIA_N2))
_reg("kpi_summary_empty", O.kpi_summary(_eq(sm=NOWHERE.sm)))(
    lambda f: A.kpi_summary(f, P, NOWHERE))
_reg("kpi_trend", O.kpi_trend())(lambda f: A.kpi_trend(f, P))
_reg("margin_kpi", O.margin_kpi())(lambda f: A.margin_kpi(f, P))
_reg("margin_kpi_filtered", O.margin_kpi(_eq(sm="ASIA")))(
    lambda f: A.margin_kpi(f, P, ASIA))

# --- page analyses ---------------------------------------------------------------

_LISTS = {
    # name: (analysis fn, oracle name, key, n)
    "mal_grubu_analysis": (A.group_analysis, "mal_grubu", "mal_grubu", 10),
    "urun_grubu_analysis": (A.product_group_analysis, "urun_grubu", "urun_grubu", 10),
    "urun_analysis": (A.product_analysis, "urun", "urun_kod", 20),
}
for _name, (_fn, _on, _key, _n) in _LISTS.items():
    _reg(_name, O.analysis(_on))(lambda f, fn=_fn: fn(f, P))
    _reg(f"{_name}_worst", O.top(O.analysis(_on), "adet_deg", _n, False, _key))(
        lambda f, fn=_fn, k=_key, n=_n: A.worst(fn(f, P), k, n))
    _reg(f"{_name}_best", O.top(O.analysis(_on), "adet_deg", _n, True, _key))(
        lambda f, fn=_fn, k=_key, n=_n: A.best(fn(f, P), k, n))
    _reg(f"{_name}_reasons", O.with_reason(O.analysis(_on)))(
        lambda f, fn=_fn: with_reason(fn(f, P)))

_reg("mal_grubu_analysis_no_floor", O.analysis("mal_grubu", min_ciro=0))(
    lambda f: A.group_analysis(f, P, NO_FLOOR))
_reg("mal_grubu_analysis_filtered", O.analysis("mal_grubu", _eq(sm="ASIA", nitelik="N2")))(
    lambda f: A.group_analysis(f, P, ASIA_N2))
_reg("urun_analysis_worst_reasons",
     O.top(O.with_reason(O.analysis("urun")), "adet_deg", 20, False, "urun_kod"))(
    lambda f: A.worst(with_reason(A.product_analysis(f, P)), "urun_kod", 20))

_reg("urun_most_sold", O.top(O.analysis("urun_adet"), "adet_cur", 20, True, "urun_kod"))(
    lambda f: A.most(A.products_by_units(f, P), "urun_kod", "adet_cur", 20))
_reg("urun_least_sold",
     O.top(f"SELECT * FROM ({O.analysis('urun_adet')}) z WHERE adet_cur > 0", "adet_cur", 20,
           False, "urun_kod"))(
    lambda f: A.least(A.products_by_units(f, P), "urun_kod", "adet_cur", 20))
_reg("urun_min_units", O.analysis("urun_adet", min_adet=MIN_ADET))(
    lambda f: A.products_by_units(f, P, min_adet=MIN_ADET))
_reg("urun_most_revenue", O.top(O.analysis("urun_ciro"), "ciro_cur", 20, True, "urun_kod"))(
    lambda f: A.most(A.products_by_revenue(f, P), "urun_kod", "ciro_cur", 20))
_reg("urun_least_revenue",
     O.top(O.analysis("urun_ciro", _eq(sm="ASIA")), "ciro_cur", 20, False, "urun_kod"))(
    lambda f: A.least(A.products_by_revenue(f, P, ASIA), "urun_kod", "ciro_cur", 20))

_reg("margin_by_group", O.analysis("marj_mal_grubu"))(lambda f: A.group_margin(f, P))
_reg("margin_by_group_loss", O.top(O.analysis("marj_mal_grubu"), "marj_fark", 10, False,
                                   "mal_grubu"))(
    lambda f: A.worst(A.group_margin(f, P), "mal_grubu", 10, by="marj_fark"))
_reg("margin_by_group_gain", O.top(O.analysis("marj_mal_grubu"), "marj_fark", 10, True,
                                   "mal_grubu"))(
    lambda f: A.best(A.group_margin(f, P), "mal_grubu", 10, by="marj_fark"))
_reg("margin_by_product", O.analysis("marj_urun"))(lambda f: A.product_margin(f, P))
_reg("margin_by_product_loss", O.top(O.analysis("marj_urun"), "marj_fark", 10, False,
                                     "urun_kod"))(
    lambda f: A.worst(A.product_margin(f, P), "urun_kod", 10, by="marj_fark"))
_reg("margin_by_product_gain", O.top(O.analysis("marj_urun"), "marj_fark", 10, True,
                                     "urun_kod"))(
    lambda f: A.best(A.product_margin(f, P), "urun_kod", 10, by="marj_fark"))
_reg("margin_reasons_group", O.margin_reasons(O.analysis("marj_mal_grubu"), "mal_grubu"))(
    lambda f: margin_reasons(A.group_margin(f, P), ["mal_grubu"]))
_reg("margin_reasons_product", O.margin_reasons(O.analysis("marj_urun"), "urun_kod"))(
    lambda f: margin_reasons(A.product_margin(f, P), ["urun_kod"]))

# --- drill-downs -----------------------------------------------------------------

_reg("products_of_group",
     O.drill("mal_grubu", "urun_kod", ["urun_ad"], ("adet", "ciro"), ("fire",), MG,
             extra=[O.deg("adet")]))(lambda f: D.named("products_of_group", f, P, MG))
_reg("products_of_all_groups",
     O.drill("mal_grubu", "urun_kod", ["urun_ad"], ("adet", "ciro"), ("fire",), None,
             extra=[O.deg("adet")]))(lambda f: D.named("products_of_group", f, P))
_reg("groups_of_urun_grubu",
     O.drill("urun_grubu", "mal_grubu", ["ust_mal"], ("adet", "ciro"), ("fire",), UG,
             extra=[O.deg("adet")], child_non_empty=True))(
    lambda f: D.named("groups_of_product_group", f, P, UG))

for _tag, _parent, _key in (("mal", "mal_grubu", MG), ("ug", "urun_grubu", UG),
                            ("urun", "urun_kod", UK)):
    _reg(f"stores_falling_by_{_tag}", O.falling(_parent, _key))(
        lambda f, p=_parent, k=_key: D.falling_stores(f, P, p, k))
    _reg(f"stores_rising_by_{_tag}", O.rising(_parent, _key))(
        lambda f, p=_parent, k=_key: D.rising_stores(f, P, p, k))
_reg("stores_falling_by_mal_filtered", O.falling("mal_grubu", MG, conds=_eq(sm="ASIA")))(
    lambda f: D.falling_stores(f, P, "mal_grubu", MG, ASIA))
_reg("stores_falling_all_groups", O.falling("mal_grubu", None))(
    lambda f: D.falling_stores(f, P, "mal_grubu"))
_reg("stores_rising_all_groups", O.rising("mal_grubu", None))(
    lambda f: D.rising_stores(f, P, "mal_grubu"))
_reg("stores_falling_all_products", O.falling("urun_kod", None))(
    lambda f: D.falling_stores(f, P, "urun_kod"))
_reg("stores_rising_all_product_groups", O.rising("urun_grubu", None))(
    lambda f: D.rising_stores(f, P, "urun_grubu"))

_STORE_LISTS = {
    "stores_most_units": (("adet", "ciro"), [O.deg("adet")], "adet_cur", True),
    "stores_least_units": (("adet", "ciro"), [O.deg("adet")], "adet_cur", False),
    "stores_most_revenue": (("adet", "ciro"), [O.deg("adet"), O.deg("ciro")], "ciro_cur", True),
    "stores_least_revenue": (("adet", "ciro"), [O.deg("adet"), O.deg("ciro")], "ciro_cur",
                             False),
}
for _name, (_ms, _extra, _by, _largest) in _STORE_LISTS.items():
    for _suffix, _key in (("", UK), ("_all_products", None)):
        _reg(_name + _suffix,
             O.drill("urun_kod", "magaza_kod", O.STORE_LABELS, _ms, (), _key, extra=_extra,
                     order_by=_by, largest=_largest, n=10, positive_only=not _largest))(
            lambda f, nm=_name, k=_key: D.named(nm, f, P, k))

_MARGIN_EXTRA = ["marj_cur - marj_prev AS marj_fark", O.deg("marj")]
for _name, _child, _labels in (("stores_top_margin", "magaza_kod", O.STORE_LABELS),
                               ("products_top_margin", "urun_kod", ["urun_ad"])):
    for _suffix, _key in (("", MG), ("_all_groups", None)):
        _reg(_name + _suffix,
             O.drill("mal_grubu", _child, _labels, ("marj", "ciro", "adet"), (), _key,
                     having=["marj_cur > 0"], extra=_MARGIN_EXTRA, order_by="marj_cur",
                     largest=True, n=10))(
            lambda f, nm=_name, k=_key: D.named(nm, f, P, k))

_reg("stores_falling_all_products_named",
     "SELECT f.*, p.urun_ad, substring(coalesce(p.urun_ad, f.urun_kod), 1, 30) || '...' "
     f"AS baslik FROM ({O.falling('urun_kod', None)}) f LEFT JOIN ({O.analysis('urun')}) p "
     "ON f.urun_kod = p.urun_kod")(
    lambda f: D.falling_stores_named(f, P))
_reg("product_name_lookup",
     f"SELECT urun_kod, urun_ad FROM ({O.analysis('urun_adet')}) u WHERE urun_kod = {O.q(UK)}")(
    lambda f: D.product_name(A.products_by_units(f, P), UK))
_reg("kpi_by_year",
     "SELECT yil, CAST(SUM(adet) AS DOUBLE) AS adet, CAST(SUM(ciro) AS DOUBLE) AS ciro, "
     "CAST(SUM(marj) AS DOUBLE) AS marj, CAST(SUM(ABS(fire)) AS DOUBLE) AS fire FROM veri "
     "WHERE yil IN (1999, 2000) GROUP BY yil")(lambda f: A.totals_by_period(f, P))

# Every selector (FLT-1..7) against the oracle.
_reg("kpi_summary_filtered_bs", O.kpi_summary(_eq(bs=BS)))(
    lambda f: A.kpi_summary(f, P, Selection(bs=BS)))
_reg("urun_analysis_filtered_store", O.analysis("urun", _eq(magaza_kod="1"), min_ciro=0))(
    lambda f: A.product_analysis(f, P, Selection(magaza="1", min_ciro=0)))
_reg("mal_grubu_analysis_filtered_product",
     O.analysis("mal_grubu", _eq(urun_grubu=UG, ust_mal=UST), min_ciro=0))(
    lambda f: A.group_analysis(f, P, Selection(urun_grubu=UG, ust_mal=UST, min_ciro=0)))
_reg("margin_by_product_filtered_group",
     O.analysis("marj_urun", _eq(mal_grubu=MG, sm="ASIA"), min_ciro=0))(
    lambda f: A.product_margin(f, P, Selection(mal_grubu=MG, sm="ASIA", min_ciro=0)))
_reg("stores_rising_by_ug_filtered", O.rising("urun_grubu", UG, conds=_eq(bs=BS)))(
    lambda f: D.rising_stores(f, P, "urun_grubu", UG, Selection(bs=BS)))

# --- text and direction columns ---------------------------------------------------

_reg("product_short_labels",
     "SELECT urun_kod, urun_ad, "
     + ", ".join(f"CASE WHEN length(urun_ad) > {n} THEN substring(urun_ad, 1, {n}) || '...' "
                 f"ELSE urun_ad END AS kisa_ad_{n}" for n in (35, 40, 50))
     + f" FROM ({O.analysis('urun', min_ciro=0)}) s")(
    lambda f: A.product_analysis(f, P, NO_FLOOR).select(
        "urun_kod", "urun_ad",
        *[short_label("urun_ad", n).alias(f"kisa_ad_{n}") for n in (35, 40, 50)]))
_reg("direction_flags",
     "SELECT urun_kod, "
     "CASE WHEN adet_deg > 0 THEN 'up' WHEN adet_deg < 0 THEN 'down' ELSE 'flat' END AS adet_yon, "
     "CASE WHEN ciro_deg > 0 THEN 'up' WHEN ciro_deg < 0 THEN 'down' ELSE 'flat' END AS ciro_yon, "
     "CASE WHEN marj_cur - marj_prev > 0 THEN 'up' ELSE 'down' END AS marj_yon "
     f"FROM ({O.analysis('urun_adet')}) s")(
    lambda f: A.products_by_units(f, P).select(
        "urun_kod", direction3("adet_deg").alias("adet_yon"),
        direction3("ciro_deg").alias("ciro_yon"),
        direction2(F.col("marj_cur") - F.col("marj_prev")).alias("marj_yon")))

# --- reports ---------------------------------------------------------------------

for _rname in R.REPORTS:
    _reg(f"report_{_rname}", O.report(_rname))(
        lambda f, r=_rname: R.report_table(r, f, P, ALL))


_reg("report_mal_grubu_empty", O.report("mal_grubu", _eq(sm=NOWHERE.sm)))(
    lambda f: R.report_table("mal_grubu", f, P, NOWHERE))


# --- driver entry points ---------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: merchandise groups with the largest unit fall, with reasons."""
    fact = fixture_fact(spark, SMOKE_DIR, P)
    return A.worst(with_reason(A.group_analysis(fact, P)), "mal_grubu", 10)


def _training_data():
    """The queries of the training-data operators, where they can be imported."""
    try:
        from periodlens.llm import queries as training
    except ImportError:
        return {}, {}
    found, sql = dict(training.QUERIES), dict(training.SQL)
    try:
        import corpus_pipeline
    except ImportError:
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    return found, sql | ({"pipeline": corpus_pipeline.ORACLE_SQL}
                         if corpus_pipeline.ORACLE_SQL else {})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(fn):
        return lambda spark, sf_dir: fn(fixture_fact(spark, sf_dir, P))
    return {name: run(fn) for name, fn in _SPARK.items()} | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) | _training_data()[1]
