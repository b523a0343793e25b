"""Tables and checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder and a cluster a folder in the warehouse, unless that is
    on a local disk, which raises an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        local = sc.master == "local" or sc.master.startswith("local[")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not local and (warehouse.startswith("file:") or "://" not in warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-") if local else f"{warehouse}/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any store works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, from files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs read it with its columns pruned. drop_written deletes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path_written = path
    return out


def drop_written(*tables: DataFrame | None) -> None:
    """Delete tables that `written` made, once nothing that is still to run reads them."""
    for t in tables:
        if t is not None:
            remove(t.sparkSession, t.path_written)
