"""The fixture's star join with a hot part key (a third of lineitem rows) and
dimensions too large to broadcast: AQE splits the hot sort-merge-join
partition along map-task boundaries, and the fact is unchanged by it."""

import contextlib

from pyspark.sql import functions as F

from periodlens.sources.fixture import fixture_fact

from .conftest import SF_SMALL

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "32",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _skewed_tables(spark, root):
    for t in ("part", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    hot = li.agg(F.min("l_partkey")).first()[0]
    # Several files, so the hot partition has several map outputs to split by.
    (li.withColumn("l_partkey", F.when(F.rand(3) < 0.34, F.lit(hot))
                   .otherwise(F.col("l_partkey")))
       .repartition(8).write.parquet(f"{root}/lineitem.parquet"))


def test_hot_part_key_is_split(spark, tmp_path):
    root = str(tmp_path / "skewed")
    _skewed_tables(spark, root)

    def run(skew_join):
        with conf(spark, {**SKEW_CONF, "spark.sql.adaptive.skewJoin.enabled": skew_join}):
            agg = (fixture_fact(spark, root).groupBy("urun_kod", "magaza_kod", "yil")
                   .agg(F.sum("ciro").alias("ciro"), F.count("*").alias("n")))
            rows = sorted(agg.collect())
            plan = agg._jdf.queryExecution().executedPlan().toString()
        return rows, plan

    split_rows, plan = run("true")
    part_joins = [ln for ln in plan.split("\n")
                  if "SortMergeJoin" in ln and "l_partkey" in ln and "*(" in ln]
    assert part_joins and all("skew=true" in ln for ln in part_joins), plan
    plain_rows, plain_plan = run("false")
    assert "skew=true" not in plain_plan
    assert split_rows == plain_rows
