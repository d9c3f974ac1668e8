"""Report datasets (RPT-1..8).

A report is a set of named tables ("sheets"): an info row, ranked lists and
the whole analysis. ``write_report`` writes each sheet as its own dataset
``<out>/<report>/<sheet>/`` (parquet, or CSV with header); the workbook
container of the reference is not built.

The analysis behind the sheets is computed once and written to the shared
folder of ``spark.checkpoint.dir``; every sheet, of either format, is read from
there (the lineage is cut, and a lost executor does not send the ranking back to
the fact), and the folder is deleted afterwards.
"""

from __future__ import annotations

import datetime as dt
import unicodedata
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import timestamp_text
from ..operators.filters import Selection
from ..operators.ranking import top_n
from ..operators.reasons import with_reason
from ..params import Periods
from ..session import drop_path, scratch_path
from . import analyses as A

SHEET_COL = "sayfa"


@dataclass(frozen=True)
class Sheet:
    name: str
    table: str = "main"
    by: str | None = None       # None: every row of the table
    n: int | None = None
    largest: bool = False
    positive_only: bool = False


@dataclass(frozen=True)
class Table:
    build: Callable[[DataFrame, Periods, Selection], DataFrame]
    key: str


@dataclass(frozen=True)
class ReportSpec:
    title: str | None
    tables: dict[str, Table]
    sheets: tuple[Sheet, ...]
    show_floor: bool = True


def _reasoned(fn):
    def build(fact, periods, selection):
        return with_reason(fn(fact, periods, selection)).drop("neden_kod", "renk")
    return build


def _ranked(worst_name: str, best_name: str, by: str, n: int, positive_least=False):
    return (Sheet(worst_name, by=by, n=n, largest=False, positive_only=positive_least),
            Sheet(best_name, by=by, n=n, largest=True))


# Report titles and sheet names as the reference writes them.
ALL_SHEET = "Tüm Veriler"
REPORTS: dict[str, ReportSpec] = {
    # RPT-1: merchandise groups (the reference gives this report no title)
    "mal_grubu": ReportSpec(
        None, {"main": Table(_reasoned(A.group_analysis), "mal_grubu")},
        (*_ranked("En Kötü 20", "En İyi 20", "adet_deg", 20), Sheet(ALL_SHEET))),
    # RPT-2: product groups
    "urun_grubu": ReportSpec(
        "Ürün Grubu Analizi",
        {"main": Table(_reasoned(A.product_group_analysis), "urun_grubu")},
        (*_ranked("En Kötü 20", "En İyi 20", "adet_deg", 20), Sheet(ALL_SHEET))),
    # RPT-3: products
    "urun": ReportSpec(
        "Ürün Analizi", {"main": Table(_reasoned(A.product_analysis), "urun_kod")},
        (*_ranked("En Kötü 50", "En İyi 50", "adet_deg", 50), Sheet(ALL_SHEET))),
    # RPT-4: most / least sold products (least: units > 0)
    "adet": ReportSpec(
        "En Çok / En Az Satan Ürünler",
        {"main": Table(lambda f, p, s: A.products_by_units(f, p, s), "urun_kod")},
        (Sheet("En Çok Satan 50", by="adet_cur", n=50, largest=True),
         Sheet("En Az Satan 50", by="adet_cur", n=50, positive_only=True),
         Sheet(ALL_SHEET)), show_floor=False),
    # RPT-5: most / least revenue products
    "ciro": ReportSpec(
        "En Çok / En Az Ciro Yapan Ürünler",
        {"main": Table(A.products_by_revenue, "urun_kod")},
        (Sheet("En Çok Ciro 50", by="ciro_cur", n=50, largest=True),
         Sheet("En Az Ciro 50", by="ciro_cur", n=50), Sheet(ALL_SHEET)), show_floor=False),
    # RPT-6: net margin, groups and products (no whole sheet for products)
    "marj": ReportSpec(
        "Net Marj Analizi",
        {"main": Table(A.group_margin, "mal_grubu"),
         "urun": Table(A.product_margin, "urun_kod")},
        (Sheet("Mal Grubu - Kayıp", by="marj_fark", n=20),
         Sheet("Mal Grubu - Kazanç", by="marj_fark", n=20, largest=True),
         Sheet("Mal Grubu - Tümü"),
         Sheet("Malzeme - Kayıp", table="urun", by="marj_fark", n=20),
         Sheet("Malzeme - Kazanç", table="urun", by="marj_fark", n=20, largest=True))),
}


def _sheet_df(sheet: Sheet, table: DataFrame, key: str) -> DataFrame:
    if sheet.by is None:
        return table
    src = table.where(F.col(sheet.by) > 0) if sheet.positive_only else table
    return top_n(src, sheet.by, sheet.n, sheet.largest, tie=[key])


def report_sheets(name: str, fact: DataFrame, periods: Periods,
                  selection: Selection = Selection(),
                  tables: dict[str, DataFrame] | None = None) -> list[tuple[str, DataFrame]]:
    """The data sheets of a report as lazy DataFrames, in sheet order."""
    spec = REPORTS[name]
    tables = tables or {t: tb.build(fact, periods, selection) for t, tb in spec.tables.items()}
    return [(s.name, _sheet_df(s, tables[s.table], spec.tables[s.table].key))
            for s in spec.sheets]


def report_table(name: str, fact: DataFrame, periods: Periods,
                 selection: Selection = Selection()) -> DataFrame:
    """All data sheets of a report in one DataFrame with the sheet name in
    ``sayfa`` (columns a sheet lacks are null)."""
    parts = [df.select(F.lit(sheet).alias(SHEET_COL), "*")
             for sheet, df in report_sheets(name, fact, periods, selection)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def info_row(spark: SparkSession, name: str, selection: Selection = Selection(),
             now: dt.datetime | None = None) -> DataFrame:
    """RPT-7: filter text, floor (absent in RPT-4/5), time in the session's time
    zone (SCL-9), report name (absent in RPT-1)."""
    spec = REPORTS[name]
    cols = [F.lit(selection.text()).alias("filtre")]
    if spec.show_floor:
        cols.append(F.lit("₺" + f"{(selection.min_ciro or 0):,.0f}").alias("min_ciro"))
    cols.append(timestamp_text(now).alias("tarih"))
    if spec.title is not None:
        cols.append(F.lit(spec.title).alias("rapor"))
    return spark.range(1).select(*cols)


def sheet_slug(sheet: str) -> str:
    """Folder name of a sheet: ASCII, lower case, '_' between words."""
    s = sheet.replace("ı", "i").replace("İ", "I")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    out = "".join(c.lower() if c.isalnum() else "_" for c in s)
    return "_".join(p for p in out.split("_") if p)


# Quotes are doubled; blanks, line breaks and '' are kept; null is written \N.
# Read with these and ``multiLine``.
CSV_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N",
               "lineSep": "\n"}


def _write(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.parquet(path)


def write_report(spark: SparkSession, name: str, fact: DataFrame, periods: Periods,
                 out: str, selection: Selection = Selection(), fmt: str = "parquet",
                 now: dt.datetime | None = None,
                 product_base: DataFrame | None = None) -> dict[str, str]:
    """Write every sheet of a report; returns sheet name -> path. Empty
    results still get their (empty) datasets with the full schema (RPT-8).

    ``product_base``: a ``plans.page.product_base`` of this fact and
    selection; the report tables are then aggregated from it."""
    spec = REPORTS[name]
    base = f"{out.rstrip('/')}/{name}"
    paths = {"Bilgi": f"{base}/bilgi"}
    _write(info_row(spark, name, selection, now), paths["Bilgi"], fmt)
    src, src_sel = fact, selection
    if product_base is not None:
        src, src_sel = product_base, Selection(min_ciro=selection.min_ciro)
    scratch = scratch_path(spark, f"report-{name}-{uuid.uuid4().hex}")
    try:
        tables = {}
        for tname, tb in spec.tables.items():
            tb.build(src, periods, src_sel).write.parquet(f"{scratch}/{tname}")
            tables[tname] = spark.read.parquet(f"{scratch}/{tname}")
        for sheet, df in report_sheets(name, src, periods, src_sel, tables):
            paths[sheet] = f"{base}/{sheet_slug(sheet)}"
            _write(df, paths[sheet], fmt)
    finally:
        drop_path(spark, scratch)
    return paths


def write_reports(spark: SparkSession, fact: DataFrame, periods: Periods, out: str,
                  selection: Selection = Selection(), names=None, fmt: str = "parquet",
                  now: dt.datetime | None = None, parallel: int = 3,
                  product_base: DataFrame | None = None) -> dict[str, dict]:
    """Write several reports (all six by default) from one pass over the
    fact: every report table keys on the product hierarchy, so they are all
    aggregated from one product base, kept for the run (MEMORY_AND_DISK,
    lineage-backed) unless one is given. Reports are written concurrently."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel, inheritable_thread_target

    from .page import product_base as make_base
    names = list(names or REPORTS)
    now = now or dt.datetime.now()
    pb = product_base
    if pb is None:
        pb = make_base(fact, periods, selection).persist(StorageLevel.MEMORY_AND_DISK)
    write = inheritable_thread_target(spark)(write_report)
    try:
        if product_base is None:
            pb.count()
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            futs = {n: pool.submit(write, spark, n, fact, periods, out, selection, fmt,
                                   now, pb) for n in names}
            return {n: f.result() for n, f in futs.items()}
    finally:
        if product_base is None:
            pb.unpersist()
