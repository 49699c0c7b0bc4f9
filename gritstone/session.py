"""Session defaults, and the way the library reaches the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def builder(app: str = "gritstone") -> SparkSession.Builder:
    """Defaults that hold from a laptop to a cluster; everything stays overridable."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions of it which run in
    Python workers can be imported there whatever the workers' path is."""
    sc = spark.sparkContext
    if getattr(sc, "_gritstone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="gritstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "gritstone_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    sc.addPyFile(archive)
    sc._gritstone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``, or what setCheckpointDir was given. Only a
    local session without either gets a folder of its own; anywhere else that is an error, since
    executors would write to disks that the others cannot read."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        chosen = sc._jsc.sc().getCheckpointDir()
        path = chosen.get() if chosen.isDefined() else getattr(shared_dir, "own", None)
    if not path:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gritstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = shared_dir.own = "file://" + folder
    return path.rstrip("/")


def durable(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut a lineage: write to the shared folder and read back, so that a lost executor costs a reread and
    never a recomputation of what came before. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gritstone-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that durable has written and that nothing reads again."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    if folder.getName().startswith("gritstone-"):
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
