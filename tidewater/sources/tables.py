"""Reading and writing: panels, predictions by model and validation, histories, deliverables and checkpoints."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewater.functions.nulls import sanitise


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def require(spark: SparkSession, paths: Iterable[str]) -> None:
    absent = [p for p in paths if not exists(spark, p)]
    if absent:
        raise FileNotFoundError(f"missing: {', '.join(absent)}")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a schema nothing is inferred; without, types come from a pass over the file."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet or CSV table; only `columns` are read."""
    df = read_csv(spark, path, schema) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_panel(spark: SparkSession, directory: str, form: str = "parquet", target: str = "avg_delay_minutes_next_30m") -> tuple[DataFrame, DataFrame]:
    """Both splits in one frame with a column `split`, so that windows and joins are planned once; and the layouts."""
    paths = {n: f"{directory}/{n}.{form}" for n in ("train", "test", "layout_info")}
    require(spark, paths.values())
    parts = [sanitise(read_table(spark, paths[n])).withColumn("split", F.lit(n)) for n in ("train", "test")]
    panel = parts[0].unionByName(parts[1], allowMissingColumns=True)
    if target not in panel.columns:
        raise ValueError(f"the training table lacks {target}")
    return panel, sanitise(read_table(spark, paths["layout_info"]))


def load_template(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a submission template with `ord`, their order in the file.

    A template is one small file, read as one partition, so the running number is the order.
    """
    return read_table(spark, path).coalesce(1).withColumn("ord", F.monotonically_increasing_id())


def write_predictions(df: DataFrame, root: str, model: str, validation: str) -> None:
    named = df.withColumn("model", F.lit(model)).withColumn("validation", F.lit(validation))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "validation").parquet(root)


def read_predictions(spark: SparkSession, root: str, model: str, validation: str) -> DataFrame:
    """Only the folder of this model and validation is listed and read."""
    found = spark.read.parquet(root).filter((F.col("model") == model) & (F.col("validation") == validation))
    return found.drop("model", "validation")


def artifact_name(stage: str, kind: str, alpha: float | None = None) -> str:
    """The one place where artifact names are made."""
    tail = "" if alpha is None else f"_alpha_{str(alpha).replace('.', 'p')}"
    return f"{stage}_{kind}{tail}"


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Evaluated combinations, each once: windows and steps as sorted arrays of numbers."""
    ints = lambda c: F.array_sort(F.transform(F.filter(F.split(F.col(c), " "), lambda x: x != ""), lambda x: x.cast("int")))
    rows = spark.read.parquet(path).withColumn("windows", ints("roll_windows")).withColumn("steps", ints("lag_steps"))
    return rows.dropDuplicates(["kind", "windows", "steps"])


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """A deliverable: one file, in the order of a column that isn't written."""
    out = df.orderBy(order).drop(order) if order else df
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, content: dict, path: str) -> None:
    """Metadata beside an artifact."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(content, indent=2, sort_keys=True).encode()))
    out.close()


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at a path: read if it was written completely, else made and written."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def publish(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def describe_artifacts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, path and whether it is there."""
    return spark.createDataFrame([(n, p, exists(spark, p)) for n, p in paths.items()], "name string, path string, available boolean")
