"""Reading and writing tables: Parquet, delimited text with quoted markup, stage results."""

from __future__ import annotations

from contextlib import contextmanager, nullcontext
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sitewright.session import new_table_path
from sitewright.sources.delimited import read_delimited

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a table over all cores if its files give fewer partitions than there are cores.

    Meant for costly row-local work on small or unsplittable files. A table with a partition per core, as any
    large table has, is returned as it is, so there is no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def read_spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return spread(read_parquet(spark, folder, name), key)


def read_table(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Delimited files with header, whose quoted fields may hold quotes, separators and line breaks; a file is read by many tasks."""
    return read_delimited(spark, path, StructType.fromDDL(schema) if isinstance(schema, str) else schema, sep)


def write_table(df: DataFrame, path: str, sep: str = ",") -> str:
    """Write delimited files with header.

    Existing data are overwritten, so never pass the path the frame was read from; use a new path. One file is
    written per partition.
    """
    df.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue='""')
    return path


def save_stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back.

    With ``release`` the shuffle files of this write go when it has ended, else when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with _shuffles_released(spark) if release else nullcontext():
        df.write.mode("error").parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    stage.stage_path = path
    return stage


def drop_stage(stage: DataFrame | None) -> None:
    """Delete the files of a frame made by ``save_stage`` that nothing will read any more."""
    if stage is not None:
        spark = stage.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(stage.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_RELEASING: dict[str, list] = {}  # by application: how many writes of concurrent threads are inside, and the setting before them
_LOCK = Lock()


@contextmanager
def _shuffles_released(spark: SparkSession):
    """Queries run inside delete their shuffle files when they end."""
    name = spark.sparkContext.applicationId
    with _LOCK:
        held = _RELEASING.setdefault(name, [0, spark.conf.get(RELEASE, None)])
        held[0] += 1
        spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                del _RELEASING[name]
                spark.conf.unset(RELEASE) if held[1] is None else spark.conf.set(RELEASE, held[1])
