"""Session and storage helpers.

On a cluster the session comes configured; :func:`get_spark` only fills in
what is unset, which is what tests and ``bench.py`` rely on.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "shroud", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", os.environ.get("SHROUD_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    session (tests, ``bench.py``) gets a folder under the system's temp folder; on a
    cluster that would be a different disk on every machine, so it is an error there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="shroud-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if getattr(sc, "_shroud_checkpoints", None) != d:
        sc.setCheckpointDir(d)
        sc._shroud_checkpoints = d
    return d


def package_archive(folder: str) -> str:
    """A zip of the package in ``folder``, which Python can import from."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(folder, "shroud.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "shroud")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, root))
    return archive


def ship_package(spark: SparkSession) -> None:
    """Make ``shroud`` importable on executors, wherever the driver was started (zip once, ``addPyFile``)."""
    sc = spark.sparkContext
    if getattr(sc, "_shroud_shipped", False):
        return
    sc.addPyFile(package_archive(os.path.realpath(tempfile.mkdtemp(prefix="shroud-pkg-"))))
    sc._shroud_shipped = True


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used where one expensive intermediate (a Python text scan, a generated
    corpus) feeds several branches of a plan: it is computed once, survives
    executor loss, and later stages start from files instead of recomputing.
    """
    from pyspark.sql import SparkSession
    ensure_checkpoint_dir(SparkSession.getActiveSession() or df.sparkSession)
    return df.checkpoint(eager=True)
