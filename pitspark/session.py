"""Session settings and durable lineage cuts."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Join sides are broadcast by AQE after their size has been measured, and oversized
# join partitions are split by it; nothing in the library forces either.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; where none is named, a scratch
    folder of this process, which only a local master can use."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(_scratch())
    return sc.getCheckpointDir().rstrip("/")


def _scratch() -> str:
    path = tempfile.mkdtemp(prefix="pitspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def folder(spark: SparkSession) -> str:
    """A new path for one intermediate table of this application."""
    return f"{checkpoint_dir(spark)}/pitspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove every intermediate table this application has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark)).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate table as Parquet below the checkpoint folder and go on from there.

    Used where a plan would otherwise be evaluated many times: a lost executor costs a re-read,
    and a reader of a few columns reads those only.
    """
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
