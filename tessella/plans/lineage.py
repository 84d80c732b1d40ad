"""Tables that cut the lineage of loops, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine if Spark runs in this process alone, else an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/tessella-shared"


#: For local folders. Hadoop's usual class starts a chmod for each file and its checksum; while that starts, it counts as
#: another process as large as the JVM. This class takes the process's umask and writes no checksums. Others ignore it.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, name: str = "state", instead_of: DataFrame | None = None) -> DataFrame:
    """df as a table of the shared folder. It goes when the application ends, or when another one is written instead of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of written(); nothing that reads it may run afterwards."""
    if path := getattr(df, "_written_at", None):
        fs, at = _files(df.sparkSession, path)
        fs.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
