"""Session construction and table access shared by every query module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; the cluster's own settings win where it sets them."""
    builder = SparkSession.builder.appName("siltwork")
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; any path that Spark's readers can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out evenly where it has fewer splits than there are cores, as a file of one row group has.

    For work that costs more than moving its input; a large table has splits enough and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_top(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset, a local master (tests, a laptop) gets a temporary one; on a cluster that would
    lose files, so it is an error there.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="siltwork-")
        atexit.register(shutil.rmtree, folder, True)
        top = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return top.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; it goes with the application."""
    path = f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a shared folder and read again: its lineage ends there, and it is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once for each application, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siltwork-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "siltwork_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(where, name)
                    z.write(file, os.path.join("siltwork", os.path.relpath(file, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
