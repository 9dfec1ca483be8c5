"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: An Arrow batch of rows with texts has about so many bytes at most, or one row.
BATCH_BYTES = 8 << 20


@functools.cache
def _own_folder() -> str:
    """A folder of this process, which goes with it."""
    path = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session, whose executors are threads of this machine, gets a folder that is removed at
    exit; on a cluster, where executors could not read it, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once into the shared checkpoint folder: what follows reads it there, also if executors go."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH_BYTES, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(name, "64m").lower()).groups()
    if not 0 < int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit] <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def let_go(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage.

    Spark removes shuffle files, broadcasts and checkpoints when the driver finds that no frame needs them any more,
    which a driver with room in its heap may not do for half an hour. A job of many short steps calls this between
    them: neither its disk nor its driver's memory then follows the number of steps.
    """
    spark.sparkContext._jvm.System.gc()


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    where, store = _place(spark, path)
    store.delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none of a folder that is not there."""
    where, store = _place(spark, path)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


def created(spark: SparkSession, path: str) -> None:
    """Makes a folder."""
    where, store = _place(spark, path)
    store.mkdirs(where)


def renamed(spark: SparkSession, path: str, to: str) -> None:
    """Moves a folder within its store; an error if that can't be done."""
    where, store = _place(spark, path)
    if not store.rename(where, _place(spark, to)[0]):
        raise OSError(f"{path} could not be moved to {to}")
