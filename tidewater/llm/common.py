"""Shared plumbing: written tables in the shared folder, distributed ranks and prefix sums, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tidewater.operators.ranks import free_name, group_buckets, ranked  # noqa: F401  used by the operators


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold: long texts make the default of 10,000 rows too large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Where it is unset, a local master gets a temporary folder and a cluster a folder in the warehouse, unless that is
    a local path, which executors don't share: then an error is raised.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        local = sc.master.startswith("local[") or sc.master == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not local and (warehouse.startswith("file:") or "://" not in warehouse):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-") if local else f"{warehouse}/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once nothing that is still to run reads them."""
    for t in tables:
        remove(t.sparkSession, t.written)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, so that any store works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage, between the parts of a long job of many queries.

    Only then does Spark delete shuffle files and broadcasts that no plan refers to any more, and the heap shrink.
    """
    spark._jvm.java.lang.System.gc()


def release() -> None:
    """Give memory that a task no longer needs back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_sample(rows: DataFrame, identity: list[Column], limit: int, seed: int, by: str | None = None, classes: int = 256) -> DataFrame:
    """At most `limit` rows, or as many of each value of the column `by`: those with the smallest hash of `identity`.

    Rows that agree in identity count as one, so copies can neither fill the sample nor keep others out, and a table
    with rows always gives some. A first pass counts different rows, which bounds what the second one shuffles; the
    limit itself is a window's, which every task applies to its own rows first. More than `classes` values raise an error.
    """
    drawn, place = free_name(rows.columns, "_draw"), free_name(rows.columns, "_place")
    marked = rows.withColumn(drawn, F.xxhash64(F.lit(seed), *identity))
    key = F.col(by) if by else F.lit("")
    sizes = marked.groupBy(key.alias("_by")).agg(F.approx_count_distinct(drawn)).take(classes + 1)
    if len(sizes) > classes:
        raise ValueError(f"more than {classes} different values of {by}")
    if not sizes:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for value, n in sizes for x in (value, 1.5 * limit / max(n, 1) + 1e-6)])
    unit = F.pmod(F.col(drawn), F.lit(1 << 30)) / float(1 << 30)
    some = marked.filter(unit < F.try_element_at(share, key)).dropDuplicates([drawn, *([by] if by else [])])
    order = Window.partitionBy(key).orderBy(drawn)
    return some.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= limit).drop(drawn, place)
