"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of the application in spark.checkpoint.dir; where that is unset, in a temporary folder, if the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/kinfold/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def written(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in any store that Spark writes, put in place as a whole: a reader sees the one before or this one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    files.delete(at, False)
    files.rename(part, at)


def read(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of a file, or of the one that was being put in place when the writer was lost; None without either."""
    for name in (path, f"{path}.part"):
        if exists(spark, name):
            found = spark.read.format("binaryFile").load(name).select("content").first()
            return bytes(found["content"])
    return None


def table_of(df: DataFrame) -> tuple[DataFrame, str]:
    """(df as a table written to the shared folder, its path): what reads it has a short plan, and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def short(df: DataFrame, few: int) -> tuple[DataFrame, str | None]:
    """df with a short plan: of at most `few` rows through the driver, else as a table, whose path comes with it."""
    rows = df.limit(few + 1).toArrow()
    return (df.sparkSession.createDataFrame(rows, df.schema), None) if rows.num_rows <= few else table_of(df)
