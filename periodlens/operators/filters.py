"""Selection of organisation and product attributes (FLT-1..10, SCL-7).

A selection becomes one Column predicate built from literals, so values with
quotes are safe and Catalyst can push the equalities into the scan."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT_MIN_CIRO
from ..schema import dim

# The "all" choice of every selector and the filter-text
# captions, as the reference shows them.
ALL = "Tümü"
NO_FILTER_TEXT = "Tüm Veriler"
CAPTIONS = {
    "sm": "SM",
    "bs": "BS",
    "magaza": "Mağaza",
    "nitelik": "Nitelik",
    "urun_grubu": "Ürün Grubu",
    "ust_mal": "Üst Mal",
    "mal_grubu": "Mal Grubu",
}

# Selector name -> fact column (FLT-1..7).
COLUMNS = {
    "sm": "sm",
    "bs": "bs",
    "magaza": "magaza_kod",
    "nitelik": "nitelik",
    "urun_grubu": "urun_grubu",
    "ust_mal": "ust_mal",
    "mal_grubu": "mal_grubu",
}


def _chosen(v) -> bool:
    return v is not None and v != "" and v != ALL


@dataclass(frozen=True)
class Selection:
    """FLT-8: absent, empty or 'Tümü' means no condition on that column."""

    sm: str | None = None
    bs: str | None = None
    magaza: str | None = None
    nitelik: str | None = None
    urun_grubu: str | None = None
    ust_mal: str | None = None
    mal_grubu: str | None = None
    min_ciro: float = DEFAULT_MIN_CIRO

    def chosen(self) -> dict[str, str]:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if f.name in COLUMNS and _chosen(getattr(self, f.name))}

    def predicate(self) -> Column | None:
        preds = [F.col(COLUMNS[k]) == F.lit(v) for k, v in self.chosen().items()]
        return reduce(lambda a, b: a & b, preds) if preds else None

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate()
        return df if p is None else df.where(p)

    def text(self) -> str:
        """SCL-7: ``"SM: x | BS: y"``; nothing chosen -> 'Tüm Veriler'."""
        parts = [f"{CAPTIONS[k]}: {v}" for k, v in self.chosen().items()]
        return " | ".join(parts) if parts else NO_FILTER_TEXT


def non_empty(df: DataFrame, key: str) -> DataFrame:
    """FLT-9: drop rows whose group key is '' or missing."""
    return df.where(f"`{key}` != ''")


def key_equals(df: DataFrame, key: str, value: str) -> DataFrame:
    """FLT-10: drill-down key equality ('' also matches a missing value)."""
    if value == "":
        return df.where(dim(key) == F.lit(""))
    return df.where(F.col(key) == F.lit(value))
