"""Session helpers: a local session for tests, shipping the package, and cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: str = "*", app: str = "rookery") -> SparkSession:
    """A local session with the settings that the library expects."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="rookery-"), "rookery_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(out)  # the driver serves this file to the executors, so it stays
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Only where none is set and the master is local (tests, a laptop) a local folder is made and set; on a cluster that is
    an error, as executors would write to disks of their own. Checkpoints that nothing refers to any more are removed if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as it is in local sessions.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession.conf.get("spark.checkpoint.dir", None), sc.master))
    return df.checkpoint(eager=True)


def checkpoint_folder(named: str | None, master: str) -> str:
    """The folder that is named; without one a temporary folder, if the master is local."""
    if named:
        return named
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="rookery-cp-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes, in the folder of the checkpoints, which all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), sc.master))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    """Partitions for explicit range partitioning; follows the session, so the cluster sets it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
