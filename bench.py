"""Benchmark: headline analyses at $BENCH_SF_DIR on local[$BENCH_CPUS].

1. ``fact_build``: the sales fact is built from the TPC-H-like tables (star
   join) and written one folder per period (the reference's one-file-per-period
   layout) into the shared folder of ``spark.checkpoint.dir``.
2. The fact is loaded with partition pruning and kept (SRC-5).
3. Each query runs once to warm up, then 5 times; the median is reported. A
   query is executed to the end with the ``noop`` sink (nothing collected).
4. ``page_pass``: the nine different analyses one page pass issues, submitted as
   concurrent jobs on the kept fact (``plans.page.run_page``, median of 5) -- the
   JSON ``value``; ``page_pass_shared_base`` takes them from one product-grain base;
   ``page_pass_sequential`` runs them one after another on the fact.
5. ``cold_from_tables``: one analysis straight from the raw tables, no reuse.

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from periodlens import Selection  # noqa: E402
from periodlens.operators.reasons import margin_reasons, with_reason  # noqa: E402
from periodlens.plans import analyses as A  # noqa: E402
from periodlens.plans import drilldown as D  # noqa: E402
from periodlens.plans.page import run_page  # noqa: E402
from periodlens.plans import reports as R  # noqa: E402
from periodlens.session import build_session, shared_dir  # noqa: E402
from periodlens.sources import (FIXTURE_PERIODS, FactCache, fixture_fact,  # noqa: E402
                                load_periods, write_periods)

P = FIXTURE_PERIODS
S = Selection()

PAGE = {
    "q01_kpi_summary": lambda f: A.kpi_summary(f, P, S),
    "q02_group_analysis": lambda f: with_reason(A.group_analysis(f, P, S)),
    "q04_product_group_analysis": lambda f: with_reason(A.product_group_analysis(f, P, S)),
    "q08_product_analysis": lambda f: with_reason(A.product_analysis(f, P, S)),
    "q11_products_by_units": lambda f: A.products_by_units(f, P, S),
    "q13_products_by_revenue": lambda f: A.products_by_revenue(f, P, S),
    "q19_group_margin": lambda f: A.group_margin(f, P, S),
    "q20_product_margin": lambda f: A.product_margin(f, P, S),
    "q21_margin_kpi": lambda f: A.margin_kpi(f, P, S),
}
EXTRA = {
    "group_worst10": lambda f: A.worst(with_reason(A.group_analysis(f, P, S)), "mal_grubu", 10),
    "product_worst20": lambda f: A.worst(with_reason(A.product_analysis(f, P, S)), "urun_kod",
                                         20),
    "group_filtered_asia_n2": lambda f: A.group_analysis(
        f, P, Selection(sm="ASIA", nitelik="N2")),
    "margin_reasons_product": lambda f: margin_reasons(A.product_margin(f, P, S),
                                                       ["urun_kod"]),
    "stores_falling_all_groups": lambda f: D.falling_stores(f, P, "mal_grubu"),
    "stores_rising_all_groups": lambda f: D.rising_stores(f, P, "mal_grubu"),
    "stores_falling_all_products": lambda f: D.falling_stores(f, P, "urun_kod"),
    "stores_top_margin_all_groups": lambda f: D.named("stores_top_margin", f, P),
    "stores_falling_one_group": lambda f: D.falling_stores(f, P, "mal_grubu",
                                                           "PROMO/red widget"),
    "report_urun_table": lambda f: R.report_table("urun", f, P, S),
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, reps: int) -> float:
    ts = []
    for _ in range(reps):
        t = time.perf_counter()
        fn()
        ts.append(time.perf_counter() - t)
    return statistics.median(ts)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    reps = int(os.environ.get("BENCH_REPS", "5"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "8g"})
    out: dict[str, float] = {}

    fact_path = os.path.join(shared_dir(spark), f"bench_fact_{os.getpid()}")
    t = time.perf_counter()
    write_periods(fixture_fact(spark, sf_dir, P), fact_path)
    out["fact_build"] = time.perf_counter() - t

    cache = FactCache(lambda: load_periods(spark, fact_path, P), partitions=cpus)
    t = time.perf_counter()
    fact = cache.get()
    n_rows = fact.count()
    out["fact_load_cache"] = time.perf_counter() - t

    for name, fn in {**PAGE, **EXTRA}.items():
        run(fn(fact))  # warm-up
        out[name] = timed(lambda fn=fn: run(fn(fact)), reps)

    def page_pass_sequential():
        for fn in PAGE.values():
            run(fn(fact))
    out["page_pass_sequential"] = timed(page_pass_sequential, reps)
    out["page_pass_shared_base"] = timed(
        lambda: run_page(fact, P, lambda name, df: run(df), S, parallel=cpus,
                         shared_base=True), reps)
    out["page_pass"] = timed(
        lambda: run_page(fact, P, lambda name, df: run(df), S, parallel=cpus), reps)

    def cold():
        run(A.worst(with_reason(A.group_analysis(fixture_fact(spark, sf_dir, P), P, S)),
                    "mal_grubu", 10))
    out["cold_from_tables_group_worst10"] = timed(cold, reps)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "page_pass_9_analyses_warm_median",
        "value": round(out["page_pass"], 4),
        "unit": "sec",
        "queries": {k: round(v, 4) for k, v in out.items()},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "fact_rows": n_rows,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
