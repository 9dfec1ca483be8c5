"""Helpers of the operators here: text columns computed batch by batch, cut lineage, ranks without a global sort."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendloom.sources.shared import BATCH_BYTES, bound_batches, let_go, shared_folder  # noqa: F401

#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: After so many cuts the driver lets go of what the steps before them left.
CUTS = 4
_cuts = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if next(_cuts) % CUTS == 0:
        let_go(df.sparkSession)
    return df.checkpoint()


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids up to so many rows (16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def of_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (distinct longs); texts are shuffled only for more ids than
    BROADCAST_IDS, which are counted first."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), key, "left_semi")


def split_of_ids(docs: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (distinct, one column), as ``of_ids`` has them, and the others."""
    ids = ids.toDF(fresh(docs, "__id"))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    other = F.broadcast(ids) if few else ids.hint("shuffle_hash")
    same = named(key) == F.col(ids.columns[0])
    return docs.join(other, same, "left_semi"), docs.join(other, same, "left_anti")


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of blocks of a string column; null is the empty text."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + block_bytes, side="right")) - 1
        high = min(max(high, low + 1), n)
        own = offsets[low : high + 1]
        yield low, high, data[own[0] : own[-1]], own - own[0]
        low = high


def map_arrow(df: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` of columns with any names; ``work`` finds them by their places."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(work, schema)


def with_text_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[np.ndarray, np.ndarray], list]], keep: bool = False) -> DataFrame:
    """``df`` with ``fields``, which ``make()`` computes from (bytes, offsets) of a block of texts; ``text`` goes, but
    with ``keep``.

    ``make`` runs once in each task; what it returns gives one array (numpy or Arrow) for each field. Arrow batches are
    held to BATCH_BYTES (the session's limit is lowered if it is higher), so a task's memory follows its longest text.
    """
    bound_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text]
    # the text comes last
    order = [*kept, df.schema[text]]
    schema = T.StructType([*(order if keep else kept), *fields])
    passed = len(order) if keep else len(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column(len(order) - 1)):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(data, offsets)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in range(passed)), *made], names=schema.names)

    return map_arrow(df.select(*(named(f.name) for f in order)), work, schema)


def is_blank() -> np.ndarray:
    """Which bytes part words: space and the five controls from tab to carriage return."""
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return blank


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each text's first word (one more entry than texts)."""
    inside = ~blank[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def slices_of(df: DataFrame, group: list[str], key: str, weight: str | None, rows: int, rows_per_slice: int = 20_000) -> tuple[Column, DataFrame]:
    """The slice of a row, and rows and weight that lie before each slice of each group.

    ``key`` is a uniform 64-bit hash, so that a slice (its leading bits) holds about ``rows_per_slice`` of the
    ``rows`` even if one group has them all. The second result has one row for each group and slice.
    """
    bits = max(0, (max(rows, 1) // rows_per_slice).bit_length())
    piece = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    sums = df.groupBy(*group, piece.alias("slice")).agg(F.count(F.lit(1)).alias("slice_rows"), F.sum(F.col(weight) if weight else F.lit(0)).cast("long").alias("slice_weight"))
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return piece, sums.withColumns({"rows_before": F.coalesce(F.sum("slice_rows").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("slice_weight").over(before), F.lit(0))})


def ranked(df: DataFrame, group: list[str], key: str, ties: list[str], weight: str | None, rows: int) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``key`` within ``group``) and ``before`` (weight of the rows that rank lower)."""
    piece, offsets = slices_of(df, group, key, weight, rows)
    order = Window.partitionBy(*group, "slice").orderBy(key, *ties)
    inner = df.withColumn("slice", piece).withColumns(
        {"rank": F.row_number().over(order) - 1, "before": F.coalesce(F.sum(F.col(weight) if weight else F.lit(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    o = offsets.select(*(F.col(g).alias(f"o_{g}") for g in group), F.col("slice").alias("o_slice"), "rows_before", "weight_before")
    joined = inner.join(o, [*(F.col(g).eqNullSafe(F.col(f"o_{g}")) for g in group), F.col("slice") == F.col("o_slice")])
    return joined.select(*df.columns, (F.col("rank") + F.col("rows_before")).cast("long").alias("rank"), (F.col("before") + F.col("weight_before")).cast("long").alias("before"))
