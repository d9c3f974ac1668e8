"""Run one page pass from the command line and write every result.

    python -m periodlens --period-file 2024=.../veri_2024.parquet \\
        --period-file 2025=.../veri_2025.parquet --out .../results --sm ASIA

or, for a fact written with ``write_periods``:

    python -m periodlens --fact .../fact --prev 2024 --cur 2025 --out .../results

Writes (parquet) ``<out>/page/<analysis>/`` for the nine analyses of the page,
``<out>/reports/<report>/<sheet>/`` for the six reports, and
``<out>/drilldown/<name>/`` for the store drill-downs of every merchandise
group, product group and product, plus the margin reasons.
"""

from __future__ import annotations

import argparse
import sys

from pyspark import StorageLevel

from .operators.filters import Selection
from .operators.reasons import margin_reasons
from .params import DEFAULT_MIN_CIRO, Periods
from .plans import analyses as A
from .plans import drilldown as D
from .plans.page import grain_base, product_base, write_page
from .plans.reports import write_reports
from .session import build_session
from .sources import load_periods, read_period_files, write_periods


def parse(argv):
    ap = argparse.ArgumentParser(prog="periodlens", description=__doc__.split("\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--period-file", action="append", metavar="YEAR=PATH",
                     help="one parquet input per period")
    src.add_argument("--fact", help="a fact folder written partitionBy('yil')")
    ap.add_argument("--prev", type=int, help="base period (default: the smaller year)")
    ap.add_argument("--cur", type=int, help="current period (default: the larger year)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--fact-out", help="with --period-file: first write the fact here "
                    "(one folder per period, rows clustered by the product hierarchy) and "
                    "run every job from that layout")
    for name in ("sm", "bs", "magaza", "nitelik", "urun-grubu", "ust-mal", "mal-grubu"):
        ap.add_argument(f"--{name}")
    ap.add_argument("--min-ciro", type=float, default=DEFAULT_MIN_CIRO)
    ap.add_argument("--format", choices=("parquet", "csv"), default="parquet",
                    help="format of the report sheets")
    ap.add_argument("--no-reports", action="store_true")
    ap.add_argument("--no-drilldowns", action="store_true")
    return ap.parse_args(argv)


def write_lists(lists: dict, out: str) -> dict[str, str]:
    paths = {}
    for name, df in lists.items():
        paths[name] = f"{out}/drilldown/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def write_store_lists(fact, periods: Periods, sel: Selection, out: str) -> dict[str, str]:
    """Every store list of every parent: the fact is read once per parent, into its
    stores' sums, and the parent's lists are taken from those."""
    paths = {}
    for parent, grain in D.STORE_GRAINS.items():
        base = grain_base(fact, periods, grain, sel).persist(StorageLevel.MEMORY_AND_DISK)
        short = "urun" if parent == "urun_kod" else parent
        lists = {f"stores_falling_by_{short}": D.falling_stores(base, periods, parent),
                 f"stores_rising_by_{short}": D.rising_stores(base, periods, parent)}
        lists |= {n: D.named(n, base, periods) for n, p in D.PARENTS.items()
                  if p == parent and D.SPECS[n].child == D.STORE[0]}
        try:
            paths |= write_lists(lists, out)
        finally:
            base.unpersist()
    return paths


def main(argv=None, spark=None) -> dict:
    a = parse(argv if argv is not None else sys.argv[1:])
    spark = spark or build_session()
    if a.period_file:
        paths = dict(x.split("=", 1) for x in a.period_file)
        paths = {int(y): p for y, p in paths.items()}
        years = sorted(paths)
        periods = Periods(a.prev or years[0], a.cur or years[-1])
        fact = read_period_files(spark, paths)
        if a.fact_out:
            write_periods(fact, a.fact_out)
            fact = load_periods(spark, a.fact_out, periods)
    else:
        if a.prev is None or a.cur is None:
            raise SystemExit("--prev and --cur are needed with --fact")
        periods = Periods(a.prev, a.cur)
        fact = load_periods(spark, a.fact, periods)
    sel = Selection(sm=a.sm, bs=a.bs, magaza=a.magaza, nitelik=a.nitelik,
                    urun_grubu=a.urun_grubu, ust_mal=a.ust_mal, mal_grubu=a.mal_grubu,
                    min_ciro=a.min_ciro)
    out = a.out.rstrip("/")
    base = product_base(fact, periods, sel).persist(StorageLevel.MEMORY_AND_DISK)
    floor = Selection(min_ciro=sel.min_ciro)  # the rest of the selection is in the bases
    try:
        done = {"page": write_page(fact, periods, f"{out}/page", sel, base=base)}
        if not a.no_reports:
            done["reports"] = write_reports(spark, fact, periods, f"{out}/reports", sel,
                                            fmt=a.format, product_base=base)
        if not a.no_drilldowns:
            done["drilldown"] = {
                **write_lists({
                    **{n: D.named(n, base, periods) for n in (
                        "products_of_group", "groups_of_product_group",
                        "products_top_margin")},
                    "margin_reasons_group": margin_reasons(
                        A.group_margin(base, periods, floor), ["mal_grubu"]),
                    "margin_reasons_product": margin_reasons(
                        A.product_margin(base, periods, floor), ["urun_kod"])}, out),
                **write_store_lists(fact, periods, sel, out)}
    finally:
        base.unpersist()
    return done


if __name__ == "__main__":
    main()
