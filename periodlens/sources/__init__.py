from .fixture import FIXTURE_PERIODS, fixture_fact, period_range_filter
from .periods import (FactCache, FactLoadError, load_periods, period_counts,
                      read_period_files, recover_periods, register, replace_period,
                      stack_periods, write_periods)

__all__ = [
    "FIXTURE_PERIODS", "fixture_fact", "period_range_filter", "FactCache",
    "FactLoadError", "load_periods", "period_counts", "read_period_files",
    "recover_periods", "register", "replace_period", "stack_periods", "write_periods",
]
