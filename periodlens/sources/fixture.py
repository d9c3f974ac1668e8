"""The sales fact built from the TPC-H-like test tables (FIXTURES.md §2).

Mapping: region -> sm, nation -> bs, supplier -> store, p_size band ->
nitelik, p_type -> urun_grubu, p_type + second word of p_name -> ust_mal,
p_type + p_name -> mal_grubu, part -> product, ship year -> period. Measures
are exact decimals so sums do not depend on the order of addition.

Plan shape: the ship-date range reaches the lineitem scan as a pushed filter;
lineitem joins part, supplier, nation and region in turn. No
join carries a broadcast hint: Spark broadcasts a side only when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold`` (planner statistics,
re-checked by AQE at run time) and uses a shuffled join otherwise, which is
what happens to ``part`` and ``supplier`` at large scale factors.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Periods
from ..schema import normalise

FIXTURE_PERIODS = Periods(1999, 2000)


def _ts(value) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def period_range_filter(ts_col: str, periods: Periods) -> Column:
    """Range predicate on a timestamp column covering both periods."""
    preds = [(F.col(ts_col) >= _ts(a)) & (F.col(ts_col) < _ts(b))
             for a, b in periods.date_ranges()]
    return reduce(lambda x, y: x | y, preds)


def fixture_fact(spark: SparkSession, sf_dir: str,
                 periods: Periods = FIXTURE_PERIODS) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    li = (read("lineitem")
          .where(period_range_filter("l_shipdate", periods))
          .select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    part = read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                               "p_retailprice")
    # Lineitem joins each dimension in turn, so the planner checks the size
    # of each one on its own (a pre-joined supplier/nation/region side would
    # be estimated as the product of the three sizes).
    j = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
           .join(read("supplier").select("s_suppkey", "s_name", "s_nationkey"),
                 F.col("l_suppkey") == F.col("s_suppkey"))
           .join(read("nation").select("n_nationkey", "n_name", "n_regionkey"),
                 F.col("s_nationkey") == F.col("n_nationkey"))
           .join(read("region").select("r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey")))

    price = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    qty = F.col("l_quantity").cast("decimal(18,2)")
    ciro = price * (F.lit(1) - disc)
    second_word = F.coalesce(F.get(F.split(F.col("p_name"), " "), 1), F.lit(""))
    fact = j.select(
        F.col("r_name").alias("sm"),
        F.col("n_name").alias("bs"),
        F.col("l_suppkey").cast("string").alias("magaza_kod"),
        F.col("s_name").alias("magaza_ad"),
        F.concat(F.lit("N"), (F.floor((F.col("p_size") - 1) / 10) + 1).cast("string"))
         .alias("nitelik"),
        F.col("p_type").alias("urun_grubu"),
        F.concat(F.col("p_type"), F.lit("/"), second_word).alias("ust_mal"),
        F.concat(F.col("p_type"), F.lit("/"), F.col("p_name")).alias("mal_grubu"),
        F.col("l_partkey").cast("string").alias("urun_kod"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("urun_ad"),
        F.year("l_shipdate").alias("yil"),
        qty.alias("adet"),
        ciro.alias("ciro"),
        (ciro - F.lit(Decimal("1.5")) * F.col("l_quantity").cast("decimal(10,2)")
         * F.col("p_retailprice").cast("decimal(10,2)")).alias("marj"),
        F.when(F.col("l_returnflag") == "R", -price * F.col("l_tax").cast("decimal(4,2)"))
         .otherwise(F.lit(0)).alias("fire"),
        F.when(F.col("l_linestatus") == "O", price * F.lit(Decimal("0.10")))
         .otherwise(-price * F.lit(Decimal("0.05"))).alias("envanter"),
        (-price * disc).alias("kampanya_zarar"),
    )
    # Exact values need at most 18 digits at these scales; a decimal of
    # precision <= 18 is held as a long, and its sums stay on long arithmetic
    # while they fit (wider products of decimals would sum as BigDecimal).
    # With ANSI mode an out-of-range value raises instead of being cut.
    fact = fact.select(*[F.col(c).cast(NARROW[c]).alias(c) if c in NARROW else F.col(c)
                         for c in fact.columns])
    return normalise(fact)


NARROW = {"adet": "decimal(18,2)", "ciro": "decimal(18,4)", "marj": "decimal(18,5)",
          "fire": "decimal(18,4)", "envanter": "decimal(18,4)",
          "kampanya_zarar": "decimal(18,4)"}
