"""Session helpers: recommended settings and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the analyses are planned for. AQE coalesces the many small shuffle
# partitions of key-grain results, turns a join into a broadcast only when the
# runtime size is below its threshold, and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Python call-site capture for error messages costs several driver-to-JVM
    # calls per column function while a plan is built; a debugging aid only.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "periodlens", extra: dict | None = None) -> SparkSession:
    """Get or create a session with the recommended settings. On a cluster
    leave ``master`` None and let the launcher decide."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names storage every executor can reach. Only in
    local mode with the setting unset (tests) a private folder is made and
    registered, so later calls in the same session agree."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="periodlens-ckpt-"))
    return sc.getCheckpointDir()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared folder for a written intermediate table."""
    return os.path.join(shared_dir(spark), name)
