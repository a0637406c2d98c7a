"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only if the session has none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _remove(path, conf) -> None:
    """Delete a folder by Spark's own file systems, so any storage that Spark writes to will do (hdfs, s3a and others)."""
    try:
        path.getFileSystem(conf).delete(path, True)
    except (Py4JError, OSError) as e:
        print(f"intermediate tables are left in {path}: {e}", file=sys.stderr)


def scratch_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A new folder of the application's own; all of them are removed when the driver's Python ends (not if it is killed)."""
    folder = f"{shared_dir(spark)}/{kind}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        sc = spark.sparkContext
        atexit.register(_remove, sc._jvm.org.apache.hadoop.fs.Path(folder), sc._jsc.hadoopConfiguration())
    return f"{folder}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` under spark.checkpoint.dir and read it back: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` as a written table, to be broadcast in joins if it has ``most`` rows at most."""
    out = materialise(df)
    return F.broadcast(out) if out.limit(most + 1).count() <= most else out
