"""Changed-only upsert as a stream: each micro-batch appends the keys that are new or different."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.operators.versions import change_types, latest

#: Keys are dealt to so many buckets, one folder each, so that a batch reads only those that its keys are in.
BUCKETS = 64


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Appended rows with the number of their batch and their bucket."""
    where, files = _path(spark, path)
    whole = T.StructType([*schema.fields, T.StructField("__batch", T.LongType()), T.StructField("__bucket", T.IntegerType())])
    return spark.read.schema(whole).parquet(path) if files.exists(where) else spark.createDataFrame([], whole)


def stored_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows appended so far; none before the first batch. Reading goes through Spark, so any shared store serves."""
    return _rows(spark, path, schema).select(*schema.names)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, replay_seconds: int = 300, ties: Sequence[str] = ()):
    """Starts the stream (available-now) and returns its query.

    Of each key a micro-batch appends the last row, by ``version`` and ``ties``, if the key is new or that row differs
    from every stored one of the key; ``late`` is set where its version lies before the highest stored one less the
    replay window. Rows delivered again add nothing, and nothing is dropped for being late, so the latest snapshot over
    ``path`` does not depend on the order of arrival.

    A batch compares with the batches before it only and writes to a folder of its own number. So one that is repeated,
    because it was written and its commit was lost, finds what it found the first time and replaces itself.
    """
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])
    marks = f"{path}/_marks"
    order = [*ties, *(c for c in columns if c not in keys and c != version and c not in ties)]

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        last = latest(df, keys, version, [c for c in columns if c not in keys], order).select(*columns).withColumn("__bucket", bucket).persist()
        touched = [r["__bucket"] for r in last.select("__bucket").distinct().collect()]  # at most BUCKETS numbers
        stored = _rows(spark, path, schema).where((F.col("__batch") < number) & F.col("__bucket").isin(touched))
        # an equal row needs no order: the struct of all columns tells
        old = stored.select(*columns).distinct()
        changed = change_types(last, latest(stored, keys, version, [c for c in columns if c not in keys], order), keys, [c for c in columns if c not in keys]).where("change_type <> 'unchanged'")
        unseen = changed.alias("n").join(old.alias("o"), [F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in columns], "left_anti")
        where, files = _path(spark, marks)
        mark = spark.read.schema(T.StructType([stream.schema[version], T.StructField("__batch", T.LongType())])).parquet(marks).where(F.col("__batch") < number).agg(F.max(version).alias("m")).first()["m"] if files.exists(where) else None
        late = F.lit(False) if mark is None else F.coalesce(F.col(version) < F.lit(mark) - F.expr(f"interval {replay_seconds} seconds"), F.lit(False))
        unseen.select(*columns, late.alias("late"), bucket.alias("__bucket")).write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/__batch={number}")
        last.agg(F.max(version).alias(version)).write.mode("overwrite").parquet(f"{marks}/__batch={number}")
        last.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_and_snapshot(spark: SparkSession, folder: str, name: str, schema: T.StructType, shared: str, keys: Sequence[str], version: str, columns: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Streams the Parquet file or folder ``name`` in ``folder`` through ``upsert_stream``; returns the latest snapshot."""
    base = f"{shared}/upsert-{uuid.uuid4().hex}"
    where, files = _path(spark, f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{folder}/{name}") if files.getFileStatus(where).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)
    upsert_stream(stream, f"{base}/rows", f"{base}/state", keys, version, ties=ties).awaitTermination()
    return latest(stored_rows(spark, f"{base}/rows", T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])), keys, version, columns, ties)
