"""Loading the period fact (SRC-1..5, SET-1).

Two layouts are read:
- one parquet file (or folder) per period, as the reference keeps them
  (``read_period_files``); the period column is added when absent;
- one folder written ``partitionBy('yil')`` (``write_periods`` /
  ``load_periods``), where the ``yil IN (prev, cur)`` filter prunes whole
  partitions at planning time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..params import Periods
from ..schema import PERIOD, FactSchemaError, lower_case_columns, normalise


class FactLoadError(RuntimeError):
    """A period file is missing or unreadable (the reference's 'not loaded')."""


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # path not found, not parquet, ...
        raise FactLoadError(f"cannot read sales data at {path}: {e}") from e


def read_period_files(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame:
    """SRC-1 + SET-1: one input per period, stacked by column name."""
    if not paths:
        raise FactLoadError("no period files given")
    return stack_periods({yil: _read(spark, path) for yil, path in paths.items()})


def stack_periods(frames: Mapping[int, DataFrame]) -> DataFrame:
    """SET-1 + DRV-7: one frame per period, in any letter case and column order,
    stacked by name; the period column is added when absent."""
    parts = []
    for yil, df in frames.items():
        df = lower_case_columns(df)
        if PERIOD not in df.columns:
            df = df.withColumn(PERIOD, F.lit(int(yil)))
        parts.append(normalise(df))
    return reduce(lambda a, b: a.unionByName(b), parts)


# Row order inside each written file: the product hierarchy, coarse to fine.
CLUSTER_BY = ("urun_grubu", "ust_mal", "mal_grubu", "urun_kod")


def write_periods(fact: DataFrame, path: str, mode: str = "overwrite",
                  cluster_by: tuple[str, ...] | None = CLUSTER_BY,
                  replace_all: bool = False, **options) -> None:
    """Write the fact one folder per period (partition pruning on read).

    An overwrite replaces the periods that ``fact`` holds and leaves the
    others; ``replace_all`` empties the folder first.

    Rows are sorted inside each output file by ``cluster_by`` (a local sort,
    no shuffle), so each parquet row group covers a narrow range of the
    product hierarchy and its min/max statistics let a pushed equality on a
    product group, parent group or merchandise group skip the other row
    groups. ``options`` go to the parquet writer (e.g. ``parquet.block.size``)."""
    if cluster_by:
        fact = fact.sortWithinPartitions(PERIOD, *cluster_by)
    (fact.write.mode(mode).options(**options)
     .option("partitionOverwriteMode", "static" if replace_all else "dynamic")
     .partitionBy(PERIOD).parquet(path))


# Folders of a replacement under way stand inside the fact folder; Spark's readers skip
# names that start with "_". ``_new-``: rows not yet checked, ``_old-``: what they replace.
_NEW, _OLD = "_new-", "_old-"


def _filesystem(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _child(spark: SparkSession, root, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name)


def _periods_in(spark: SparkSession, path: str) -> list[int]:
    fs, root = _filesystem(spark, path)
    names = (f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory())
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{PERIOD}="))


def _set_aside(spark: SparkSession, path: str) -> dict[int, str]:
    """Periods that have no folder, because a swap stopped between its two renames, and
    the name of the folder that holds their rows."""
    fs, root = _filesystem(spark, path)
    if not fs.exists(root):
        return {}
    names = sorted(f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory())
    found = {int(n.split("-")[1]): n for n in names if n.startswith(_OLD)}
    return {yil: n for yil, n in found.items() if f"{PERIOD}={yil}" not in names}


def recover_periods(spark: SparkSession, path: str) -> list[int]:
    """Put back the periods of a fact folder whose replacement broke off between its two
    renames; returns them. Not needed for reading (``load_periods`` reads such periods
    where they are) nor before the next replacement. Call it when none runs."""
    fs, root = _filesystem(spark, path)
    lost = _set_aside(spark, path)
    for yil, name in lost.items():
        _rename(fs, _child(spark, root, name), _child(spark, root, f"{PERIOD}={yil}"))
    return sorted(lost)


def _rename(fs, source, target) -> None:
    # A folder renamed onto an existing one would land inside it.
    if fs.exists(target) or not fs.rename(source, target):
        raise FactLoadError(f"cannot move {source} to {target}")


def replace_period(fact: DataFrame, path: str, yil: int,
                   cluster_by: tuple[str, ...] | None = CLUSTER_BY, **options) -> None:
    """Make one period of a fact folder hold exactly these rows (a restated
    period file), also when there are none; the other periods stay. The
    period column is set to ``yil`` where absent, else it must agree.

    The rows may come from the same folder, from this period too: they are
    written beside it and counted first, then the folders are swapped by two
    renames. Whatever fails before the swap leaves the period as it was; a
    failed second rename puts it back. Between the renames ``load_periods``
    reads the old rows, and so it does if the process ends there. One
    replacement of a period at a time; the file system must rename folders
    (HDFS, a local or shared disk)."""
    spark, yil = fact.sparkSession, int(yil)
    if PERIOD in fact.columns:
        strange = fact.where(~F.col(PERIOD).eqNullSafe(F.lit(yil))).limit(1)
        if not strange.isEmpty():
            raise FactLoadError(f"rows of another period than {yil}")
    rows = normalise(fact.withColumn(PERIOD, F.lit(yil))).drop(PERIOD)
    if cluster_by:
        rows = rows.sortWithinPartitions(*cluster_by)
    fs, root = _filesystem(spark, path)
    token = uuid.uuid4().hex
    new, old = (_child(spark, root, f"{kind}{yil}-{token}") for kind in (_NEW, _OLD))
    live = _child(spark, root, f"{PERIOD}={yil}")
    try:
        seen = Observation()
        (rows.observe(seen, F.count(F.lit(1)).alias("n"))
         .write.options(**options).parquet(new.toString()))
        _check_written(spark, new.toString(), seen.get["n"], rows.columns)
        had = fs.exists(live)
        if had:
            _rename(fs, live, old)
        try:
            _rename(fs, new, live)
        except BaseException:
            if had:
                _rename(fs, old, live)
            raise
    finally:
        fs.delete(new, True)
    # Only now: older swaps of this period that ended before they tidied up go as well.
    for f in fs.listStatus(root):
        if f.getPath().getName().startswith(f"{_OLD}{yil}-"):
            fs.delete(f.getPath(), True)


def _check_written(spark: SparkSession, path: str, n: int, columns: list[str]) -> None:
    back = _read(spark, path)
    if back.columns != columns or back.count() != n:
        raise FactLoadError(f"{path} does not hold the {n} rows that were written")


def load_periods(spark: SparkSession, path: str, periods: Periods | None = None) -> DataFrame:
    """Read a ``partitionBy('yil')`` fact; keep only the two periods. A period that is
    being swapped just now is read from where its rows stand."""
    aside = _set_aside(spark, path)
    if aside:
        whole = [f"{path}/{PERIOD}={yil}" for yil in _periods_in(spark, path)]
        parts = [lower_case_columns(spark.read.option("basePath", path).parquet(*whole))
                 ] if whole else []
        parts += [lower_case_columns(_read(spark, f"{path}/{name}"))
                  .withColumn(PERIOD, F.lit(yil)) for yil, name in aside.items()]
        df = reduce(lambda a, b: a.unionByName(b), parts)
    else:
        df = lower_case_columns(_read(spark, path))
    try:
        df = normalise(df)
    except FactSchemaError as e:
        raise FactLoadError(str(e)) from e
    if periods is not None:
        df = df.where(F.col(PERIOD).isin(*periods.years))
    return df


def period_counts(fact: DataFrame) -> DataFrame:
    """SRC-3: rows per period."""
    return fact.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("satir"))


def register(fact: DataFrame, name: str = "veri") -> DataFrame:
    """SRC-4: expose the fact to SQL under the reference's table name."""
    fact.createOrReplaceTempView(name)
    return fact


class FactCache:
    """SRC-5: keep the loaded fact for reuse, reloaded after ``ttl_seconds``
    or on ``refresh()`` (call it after ``replace_period``). Blocks are
    MEMORY_AND_DISK and lineage-backed: a lost executor's blocks are
    recomputed from the source files.

    ``partitions``: deal the kept rows round-robin into so many partitions
    (a small fact in a few files, to be scanned by all cores); by default
    they are kept as read."""

    def __init__(self, loader, ttl_seconds: float = 86400.0,
                 level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
                 partitions: int | None = None):
        self._loader, self._ttl, self._level = loader, ttl_seconds, level
        self._partitions = partitions
        self._df: DataFrame | None = None
        self._at = 0.0

    def get(self) -> DataFrame:
        if self._df is None or time.monotonic() - self._at > self._ttl:
            self.refresh()
        return self._df

    def refresh(self) -> DataFrame:
        if self._df is not None:
            self._df.unpersist()
        df = self._loader()
        if self._partitions:
            df = df.repartition(self._partitions)
        self._df = df.persist(self._level)
        self._at = time.monotonic()
        return self._df
