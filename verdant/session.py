"""Spark session settings shared by tests, the bench and the entry points."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every verdant job relies on: UTC clock, ANSI arithmetic (ratios use
# try_divide), adaptive execution for runtime re-planning, skew splitting and
# broadcast conversion based on measured sizes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "verdant",
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the verdant settings.

    On a cluster, ``master`` is left to spark-submit; locally it defaults to
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    elif not os.environ.get("SPARK_MASTER") and "spark.master" not in (extra or {}):
        builder = builder.master("local[*]")
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``verdant`` package importable on the executors' Python
    workers (grouped Arrow passes and pandas UDFs run there) by shipping it
    as a zip with ``addPyFile`` — once per application. On a cluster the
    package can equally be passed with ``--py-files``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="verdant-pkg-")
    archive = shutil.make_archive(os.path.join(out, "verdant"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="verdant")
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, lineage cuts and
    streaming checkpoints: the one the session names in
    ``spark.checkpoint.dir``. A local session (one machine, as in tests) that
    names none gets a private folder; on a cluster the setting is required,
    because executors do not see the driver's temporary folders."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="verdant-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current
