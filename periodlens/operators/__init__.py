from .filters import ALL, Selection, key_equals, non_empty
from .options import (child_pairs, children, code_of, distinct_values, store_options,
                      stores_of)
from .ranking import RANK_COL, sort_by, top_n, top_n_per_parent
from .reasons import (ReasonThresholds, margin_reason_array, margin_reasons, reason_rule,
                      with_reason)
from .two_period import (MEASURE_SOURCES, in_periods, period_sum,
                         period_totals, two_period)

__all__ = [
    "ALL", "Selection", "key_equals", "non_empty", "child_pairs", "children", "code_of",
    "distinct_values", "store_options", "stores_of", "RANK_COL", "sort_by", "top_n",
    "top_n_per_parent", "ReasonThresholds", "margin_reason_array", "margin_reasons",
    "reason_rule", "with_reason", "MEASURE_SOURCES", "in_periods",
    "period_sum", "period_totals", "two_period",
]
