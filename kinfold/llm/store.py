"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from kinfold.sources.shared import delete, shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[tuple[str, list[str]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() writes within is deleted at the end, with its entries in the catalog; results that read it must be written before."""
    _scratch.append((f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", []))
    try:
        yield
    finally:
        folder, tables = _scratch.pop()
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, folder)


def cut(df: DataFrame, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; in so many buckets by a column, a join on it leaves the table where it is.

    The shuffle files of the writing query are dropped when it ends, where this Spark can do so: later
    stages read the written table, which survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{_scratch[-1][0] if _scratch else shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        out = df.write.option("compression", "zstd")
        if buckets:
            table = f"kinfold_{path.rpartition('/')[2]}"
            out.format("parquet").bucketBy(*buckets).sortBy(buckets[1]).option("path", path).saveAsTable(table)
            if _scratch:
                _scratch[-1][1].append(table)
            return spark.table(table)
        out.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that cut() wrote for this application. Results that read them must be written before."""
    delete(spark, shared_folder(spark))
    for table in spark.catalog.listTables(pattern="kinfold_*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
