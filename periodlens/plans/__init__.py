from . import analyses, drilldown, page, reports
from .analyses import (best, group_analysis, group_margin, kpi_summary, kpi_trend, least,
                       margin_kpi, most, product_analysis, product_group_analysis,
                       product_margin, products_by_revenue, products_by_units, worst)
from .drilldown import drilldown as drill, falling_stores, named, rising_stores

__all__ = [
    "analyses", "drilldown", "page", "reports", "best", "group_analysis", "group_margin", "kpi_summary",
    "kpi_trend", "least", "margin_kpi", "most", "product_analysis",
    "product_group_analysis", "product_margin", "products_by_revenue",
    "products_by_units", "worst", "drill", "falling_stores", "named",
    "rising_stores",
]
