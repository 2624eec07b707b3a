"""Session settings and the scratch folder that cuts lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidentia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_scratch: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that spark.checkpoint.dir names; it is removed when the driver ends.

    Only a local session may go without the setting and gets a folder of its own
    machine; on a cluster that would lose rows, so it is an error there.
    """
    context = spark.sparkContext
    if context.applicationId not in _scratch:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="evidentia-")
            spark.conf.set("spark.checkpoint.dir", named)
        made = f"{named.rstrip('/')}/evidentia-{context.applicationId}"
        files, path = hadoop_path(spark, made)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch[context.applicationId] = made
    return _scratch[context.applicationId]


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application has written so far; DataFrames that read them can't be used any more."""
    made = _scratch.pop(spark.sparkContext.applicationId, None)
    if made:
        files, path = hadoop_path(spark, made)
        files.delete(path, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df once to the scratch folder and read it back.

    The result has no lineage: it survives the loss of executors, and later
    plans that use it several times don't compute it again.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, unless its folder is on PYTHONPATH, which they inherit."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='evidentia-')}/evidentia", "zip", root, Path(__file__).resolve().parent.name)
    context.addPyFile(made)
    _shipped.add(context.applicationId)
