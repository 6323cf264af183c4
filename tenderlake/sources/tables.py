"""Table scans and shared-storage writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tenderlake.sources.shipping import ship_package

#: Whether the shuffle files of a query go when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Lazy scan of ``<base>/<name>.parquet``; filters and columns reach the Parquet reader."""
    ship_package(spark)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting (as in tests) falls back to a folder below the
    warehouse; elsewhere that might be a folder of one machine, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tenderlake-work"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so later stages and retries start there.

    The shuffle files of the job go as soon as it has ended, as nothing reads them again; else they would stay until the driver happens to collect its garbage.
    A written table survives the loss of any executor and cuts the lineage; its columns can still be pruned. What a result is still read from stays
    in a folder named after the application, which may go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` has just returned. Nothing that is still to be computed may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
