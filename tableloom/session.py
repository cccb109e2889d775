"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join keys even when that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Folders of applications that are deleted with them.
_TO_DELETE: set[str] = set()
# Per call of `settled` that is under way: the folders of the steps written since.
_OPEN: list[list[str]] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators count on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(cores: int | str = "*", app: str = "tableloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own session to `configure`."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.sql.session.timeZone": "UTC",
        **RUNTIME_CONF,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = tempfile.mkdtemp(prefix="tableloom-")
    sc.setCheckpointDir(local)
    return local


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written between two steps; it goes when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/tableloom/{sc.applicationId}"
    if root not in _TO_DELETE:
        _TO_DELETE.add(root)
        folder = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    folder = f"{root}/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(folder)
    return f"{folder}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a step of an iteration to the shared folder and go on from there.

    A lost executor then costs no earlier round, and the next plan knows the true size of its input,
    so that Spark broadcasts what has become small and shuffles what has not.
    """
    path = work_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """The result of `make`, a frame or several, as written steps; the steps that led to it are deleted, as nothing reads them any more.

    `make` returns frames on which nothing else is built, and no frame built in it is used later.
    """
    _OPEN.append([])
    try:
        found = make()
        steps = _OPEN[-1]
        _OPEN[-1] = []
        result = tuple(map(cut_lineage, found)) if isinstance(found, tuple) else cut_lineage(found)
        kept = _OPEN[-1]
    except BaseException:
        _OPEN.pop()
        raise
    _OPEN.pop()
    if _OPEN:
        # To whoever is about it, the result is a step.
        _OPEN[-1].extend(kept)
    sc = spark.sparkContext
    for step in steps:
        folder = sc._jvm.org.apache.hadoop.fs.Path(step)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
    return result


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done and written.

    It does so once the driver's JVM has collected what refers to them, which a driver with little to do may put off for long.
    """
    spark.sparkContext._jvm.System.gc()
