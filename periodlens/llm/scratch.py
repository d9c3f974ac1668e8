"""Intermediate tables in the shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import drop_path, scratch_path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB (or one row) in this session, unless it has a limit
    of its own: a task then holds a few batches, however long the texts are."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


@contextmanager
def freed_shuffles(spark: SparkSession):
    """The shuffle files of a write inside go as soon as it has ended. Otherwise they stay
    until the driver happens to collect its garbage, beside those of the next writes. What
    is written must be read back, not computed again."""
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, old)


class Scratch:
    """Written tables of one operator call: they cut lineage and survive lost
    executors. ``drop`` deletes those that no later step reads; the rest stay
    as long as the returned DataFrame may be read."""

    def __init__(self, spark: SparkSession, operator: str):
        small_batches(spark)
        self.spark = spark
        self.root = scratch_path(spark, f"{operator}-{uuid.uuid4().hex}")
        self.names: set[str] = set()
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        self.names.add(name)
        df.write.mode("overwrite").parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_at_home(self, df: DataFrame, name: str, tasks: int, home: str = "home"
                      ) -> DataFrame:
        """Writes a table bucketed by ``home``, the number of the task that makes a row: a
        task's rows fall into one bucket, hence one file, and a later grouping by ``home``
        reads them where they are, without a shuffle."""
        table = f"{name}_{uuid.uuid4().hex}"
        buckets = min(max(2 * tasks, 1), 100_000)  # Spark's limit
        (df.write.bucketBy(buckets, home).option("path", self.path(name)).format("parquet")
         .saveAsTable(table))
        self.names.add(name)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            drop_path(self.spark, self.path(name))
            self.names.discard(name)

    def keep_only(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))


def send(spark: SparkSession, value):
    """Broadcasts a value of this package's classes; returns a function that gives it
    in a task. The value travels with its class, so workers need no copy of the code."""
    small_batches(spark)
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(packed.value)


def schema_of(df: DataFrame, extra: str = "") -> T.StructType:
    """The DataFrame's columns, and further ones as DDL, all nullable."""
    fields = [T.StructField(f.name, f.dataType) for f in df.schema]
    return T.StructType(fields + (T._parse_datatype_string(extra).fields if extra else []))
