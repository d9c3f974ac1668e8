from .measures import (diff, direction2, direction3, kpi_polarity, nz, pct_change,
                       ratio_pct)
from .text import (code_from_label, fixed, heading_label, money, option_label, pct,
                   short_label, signed_fixed, signed_thousands, thousands, timestamp_text)

__all__ = [
    "diff", "direction2", "direction3", "kpi_polarity", "nz", "pct_change", "ratio_pct",
    "code_from_label", "fixed", "heading_label", "money", "option_label", "pct",
    "short_label", "signed_fixed", "signed_thousands", "thousands", "timestamp_text",
]
