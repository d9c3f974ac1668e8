"""Top-k (TOP-1..13, SRT-1..2).

Order: the measure with nulls last (pandas ``nsmallest``/``nlargest`` put
NaN last), then the tie columns ascending, so the cut is deterministic.
``orderBy(..).limit(n)`` plans as ``TakeOrderedAndProject``: each task keeps
its own n best rows, no full sort, no shuffle of the whole result. The
per-parent form is ``row_number() <= n`` over a window partitioned by the
parent; up to ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark inserts a
partial ``WindowGroupLimit`` before the shuffle, so each task forwards at most n
rows per parent even for a parent holding a large share of all rows. For larger
n the children of a parent are ranked in ``PARENT_PARTS`` parts first, each
keeping its n best, and the parts' rows are ranked again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_COL = "sira"


def order_columns(by: str, largest: bool, tie: Sequence[str]) -> list[Column]:
    first = F.col(by).desc_nulls_last() if largest else F.col(by).asc_nulls_last()
    return [first] + [F.col(t).asc_nulls_last() for t in tie]


def sort_by(df: DataFrame, by: str, largest: bool, tie: Sequence[str] = ()) -> DataFrame:
    """SRT-1: full sort (a range-partitioned sort, no single-task step)."""
    return df.orderBy(*order_columns(by, largest, tie))


def top_n(df: DataFrame, by: str, n: int, largest: bool,
          tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*order_columns(by, largest, tie)).limit(n)


# Rows of one parent are first ranked in so many parts where Spark's own partial
# group limit does not apply.
PARENT_PARTS = 64
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n_per_parent(df: DataFrame, parent: str | Sequence[str], by: str, n: int,
                     largest: bool, tie: Sequence[str] = ()) -> DataFrame:
    parents = [parent] if isinstance(parent, str) else list(parent)
    order = order_columns(by, largest, tie)

    def ranked(rows: DataFrame, *keys) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return (rows.withColumn(RANK_COL, F.row_number().over(w))
                    .where(F.col(RANK_COL) <= n))

    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        part = F.pmod(F.hash(*tie, by), F.lit(PARENT_PARTS))
        df = ranked(df.withColumn("__part", part), *parents, "__part").drop("__part", RANK_COL)
    return ranked(df, *parents)
