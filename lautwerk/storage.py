"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session, whose driver is its one executor,
    may do without: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"lautwerk-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    This cuts the lineage, keeps what was computed when an executor is lost, and lets several
    branches read one result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lautwerk/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that ``durable`` returned; nothing that is still to run may read them."""
    for t in tables:
        if t is not None:
            _delete(t.sparkSession, t.durable_path)


def release(spark: SparkSession) -> None:
    """Deletes this application's tables from the shared folder, once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/lautwerk/{spark.sparkContext.applicationId}")
