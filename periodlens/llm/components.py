"""Connected components of an edge list, by Spark.

Every node above a smaller neighbour hangs below its smallest one; hanging chains
are shortened by pointer jumping until they are flat; edges are rewritten between
the roots, and what is left is done again. Each round removes every root that had a
smaller neighbour. Intermediate tables are written to the shared folder, so lost
executors cost no round; minima are taken before the shuffle, so a node with very
many edges is one row per task; labels never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` of every node that isn't the smallest of its component, for
    edges with columns ``a`` and ``b`` of one integer type (nulls and loops: none)."""
    spark = edges.sparkSession

    def oriented(df: DataFrame) -> DataFrame:
        return (df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                .where("hi <> lo").distinct())

    left = scratch.write(oriented(edges.dropna(subset=["a", "b"])), f"{name}-edges0")
    labels, labels_at, number = None, None, 0
    while not left.isEmpty():
        up = _flat(left.groupBy("hi").agg(F.min("lo").alias("root"))
                   .withColumnRenamed("hi", "node"), scratch, f"{name}-up{number}")
        if labels is None:
            labels, at = up, None
        else:
            moved = (labels.join(up.select(F.col("node").alias("root"),
                                           F.col("root").alias("to")), "root", "left")
                     .select("node", F.coalesce("to", "root").alias("root")))
            at = f"{name}-labels{number}"
            labels = scratch.write(moved.unionByName(up), at)
        low = up.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        high = up.select(F.col("node").alias("hi"), F.col("root").alias("a"))
        after = (left.join(high, "hi").join(low, "lo", "left")
                 .select("a", F.coalesce("lo_root", "lo").alias("b")))
        rest = scratch.write(oriented(after), f"{name}-edges{number + 1}")
        scratch.drop(f"{name}-edges{number}", *([labels_at] if labels_at and at else []))
        left, labels_at, number = rest, at or labels_at, number + 1
    scratch.drop(*(n for n in scratch.names if n.startswith(f"{name}-edges")))
    if labels is None:
        return spark.createDataFrame([], oriented(edges).selectExpr(
            "hi AS node", "lo AS root").schema)
    return labels


def _flat(up: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` with every root a node that hangs nowhere."""
    number = 0
    up = scratch.write(up, f"{name}-0")
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = (up.join(above, "root", "left")
                  .select("node", F.coalesce("next", "root").alias("root"),
                          F.col("next").isNotNull().alias("moved")))
        number += 1
        jumped = scratch.write(jumped, f"{name}-{number}")
        scratch.drop(f"{name}-{number - 1}")
        still = not jumped.where("moved").isEmpty()
        up = jumped.drop("moved")
        if not still:
            return up
