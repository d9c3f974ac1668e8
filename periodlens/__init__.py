"""periodlens: two-period retail sales analysis on Spark DataFrames.

Load a sales fact (organisation, product hierarchy, period, six measures),
filter it by any attribute, compare two periods per key, rank the best and
worst, drill down to stores and products, attach rule-based reasons and
write report datasets. Everything is native DataFrame expressions.
"""

from .operators.filters import Selection
from .params import DEFAULT_MIN_CIRO, Periods
from .schema import DIMENSIONS, FACT_SCHEMA, MEASURES, PERIOD, normalise

__all__ = ["Selection", "DEFAULT_MIN_CIRO", "Periods", "DIMENSIONS", "FACT_SCHEMA",
           "MEASURES", "PERIOD", "normalise"]
