"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    On one machine, as in tests, a temporary folder stands in where it is unset. On a cluster that is an
    error, as executors would write to disks that others cannot read.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            found = current.rsplit("/", 1)[0]
        elif spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="flowlens-")
        else:
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already; the folder is the cluster's scratch space
        return


def _located(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """One rename of the file system; an error if it refuses."""
    fs, target = _located(spark, path)
    if not fs.rename(target, _located(spark, to)[1]):
        raise OSError(f"{path} could not be renamed to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _located(spark, path)
    fs.delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there is removed when the driver exits."""
    path = f"{shared_dir(spark)}/flowlens-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage: later stages read files that survive the loss of any executor. Tables that
    nothing reads any more once this one is written can be named as ``done``; the others are removed when
    the driver exits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._flowlens_path = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialise`` has written, and of shuffles that led to them."""
    for table in tables:
        _remove(table.sparkSession, table._flowlens_path)
    if tables:
        collect_garbage(tables[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Spark removes the files of a shuffle once the driver has collected the garbage of its plan, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
