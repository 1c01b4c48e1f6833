"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own; a session that exists keeps its settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults above; conf keys use __ for dots."""
    builder = SparkSession.builder.master(master).appName("cohortloom")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    if master == "local" or master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="cohortloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        settings["spark.checkpoint.dir"] = folder
    settings |= {key.replace("__", "."): value for key, value in conf.items()}
    return builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cohortloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it to executors until it ends
    path = Path(folder) / "cohortloom.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, os.path.join(root.name, file.relative_to(root)))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it has fewer partitions than there are cores.

    For work that takes long for each row. Only inputs of fewer splits than cores, so small ones,
    are moved; anything larger stays as it was read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _local(spark: SparkSession) -> bool:
    """Whether driver and executors are one machine and one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    A temporary folder only where it is unset and all runs in one process; on a cluster that would be
    another folder on each machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not _local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortloom-"))
    return context.getCheckpointDir().rstrip("/")


_WRITTEN: dict[str, SparkSession] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it back.

    Cuts the lineage without localCheckpoint, so that a lost executor costs no recomputation of
    what came before. The files stay until release(), or else the end of the driver.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cohortloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, on any file system Spark knows."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended
        pass


def release() -> None:
    """Delete what materialize has written; for when the results that read it have been written themselves."""
    for path, spark in list(_WRITTEN.items()):
        remove(spark, path)
        del _WRITTEN[path]


atexit.register(release)
