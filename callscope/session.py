"""Session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", app: str = "callscope") -> SparkSession:
    """A session for one machine: tests, bench, examples. On a cluster pass your own."""
    cpus = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(max(cpus, 1)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CALLSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless their path has it already.

    The driver serves one archive of the package's source to all executors, once per application.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    known = [os.path.abspath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root in known or context.applicationId in _SHIPPED or not os.path.isdir(package):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="callscope-code-"), name)
    context.addPyFile(shutil.make_archive(base, "zip", root, name))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A session on one machine without that setting uses a fixed folder there. On a cluster it is an
    error: parts that one executor writes to its own disk are missing on the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:/tmp/callscope-checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that several reports read.

    Uses a reliable checkpoint below ``shared_folder``, so a lost executor costs a re-read and not
    a recomputation.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
