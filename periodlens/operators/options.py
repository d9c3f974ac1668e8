"""Filter-option discovery (OPT-1..10, SET-2..4).

All lists come back as flat, sorted DataFrames of distinct values or
(parent, child) pairs: a distinct is a partial + final hash aggregate, and a
parent with very many children never has to fit in one row or one task. The
reference's child order is first-seen; ours is ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_from_label, option_label
from ..schema import dim
from .filters import ALL

# Parent -> child levels of the selectors (OPT-4..7).
HIERARCHY = {
    "bs": "sm",
    "magaza_kod": "bs",
    "ust_mal": "urun_grubu",
    "mal_grubu": "ust_mal",
}


def distinct_values(fact: DataFrame, column: str) -> DataFrame:
    """OPT-1..3: distinct non-empty values, ascending."""
    return (fact.where(F.col(column) != "").select(column).distinct()
                .orderBy(F.col(column).asc()))  # non-empty: never null here


def child_pairs(fact: DataFrame, parent: str, child: str,
                extra: Sequence[str] = ()) -> DataFrame:
    """OPT-4..7: distinct (parent, child[, extra]) with a non-empty child; the
    parent may be ''."""
    cols = [parent, child, *extra]
    return (fact.where(F.col(child) != "").select(*[dim(c).alias(c) for c in cols])
                .dropDuplicates().orderBy(*[F.col(c).asc() for c in cols]))


def store_options(fact: DataFrame) -> DataFrame:
    """OPT-5 + OPT-10: BS -> (store code, store name) pairs, with the
    ``"kod - ad"`` label a selector shows. One code with two names gives two
    pairs, as in the reference."""
    return (child_pairs(fact, "bs", "magaza_kod", ["magaza_ad"])
            .withColumn("etiket", option_label("magaza_kod", "magaza_ad")))


def children(fact: DataFrame, child: str, parent_value: str | None = None) -> DataFrame:
    """OPT-8: children of a chosen parent, or of all parents (union-distinct,
    SET-4) when the parent is not chosen. One level only, as the reference."""
    parent = HIERARCHY[child]
    src = fact.where(F.col(child) != "")
    if parent_value is not None and parent_value not in ("", ALL):
        src = src.where(F.col(parent) == F.lit(parent_value))
    return src.select(child).distinct().orderBy(F.col(child).asc())


def stores_of(fact: DataFrame, bs_value: str | None) -> DataFrame:
    """OPT-9: stores are listed only once a BS is chosen."""
    if bs_value is None or bs_value in ("", ALL):
        return store_options(fact).limit(0)
    return store_options(fact.where(F.col("bs") == F.lit(bs_value)))


def code_of(label_df: DataFrame, label_col: str = "etiket") -> DataFrame:
    """OPT-10: the store code taken back from its label."""
    return label_df.withColumn("secili_kod", code_from_label(label_col))
