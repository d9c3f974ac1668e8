"""Parameters shared by all analyses: the period pair and list sizes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Periods:
    """The two periods compared: ``prev`` (base) and ``cur`` (current).

    A period is a year, as in the reference (column ``yil``)."""

    prev: int
    cur: int

    def __post_init__(self):
        if self.prev == self.cur:
            raise ValueError("the two periods must differ")

    @property
    def years(self) -> tuple[int, int]:
        return (self.prev, self.cur)

    def date_ranges(self) -> list[tuple[dt.datetime, dt.datetime]]:
        """Half-open [start, end) timestamp ranges covering both years, merged
        when the years are adjacent, for range filters that reach the scan."""
        ranges: list[list[dt.datetime]] = []
        for y in sorted(self.years):
            start, end = dt.datetime(y, 1, 1), dt.datetime(y + 1, 1, 1)
            if ranges and ranges[-1][1] == start:
                ranges[-1][1] = end
            else:
                ranges.append([start, end])
        return [(a, b) for a, b in ranges]


# Default revenue floor of the analyses (the reference's sidebar default).
DEFAULT_MIN_CIRO = 10000.0
