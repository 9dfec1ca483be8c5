"""Sharding by sampled splitters: equal bytes, in key order, no global sort in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendloom.llm.columns import cut


def weighted_splitters(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Inner boundaries of ``ranges`` ranges of equal weight; sample rows: (hash, id, weight) in integers."""
    if not len(sample) or ranges < 2:
        return np.zeros((0, 2), np.int64)
    s = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    total = np.cumsum(s[:, 2].astype(np.float64))
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return np.unique(s[at, :2], axis=0)


def in_ranges(keyed: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``keyed`` with ``range_id``: how many splitters (hash, id) are at or below the row's."""
    high, low = np.ascontiguousarray(splitters[:, 0]), np.ascontiguousarray(splitters[:, 1])
    schema = T.StructType([*keyed.schema.fields, T.StructField("range_id", T.LongType())])

    def work(batches):
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy()
            d = batch.column(batch.schema.get_field_index("tie")).to_numpy()
            first, end = np.searchsorted(high, h, side="left"), np.searchsorted(high, h, side="right")
            at = first.copy()
            for k in np.unique(first[first < end]):  # a splitter has this hash: the id decides
                rows = np.flatnonzero((first == k) & (first < end))
                at[rows] = k + np.searchsorted(low[k : end[rows[0]]], d[rows], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], names=schema.names)

    return keyed.mapInArrow(work, schema)


def draw(rows: DataFrame, wanted: float, total: int) -> np.ndarray:
    """About ``wanted`` keys, drawn with chance in proportion to their size by a hash of the row; rows are bounded."""
    rate = wanted / max(total, 1)
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(rate))
    luck = (F.xxhash64(F.lit("draw"), "h", "tie", "size") / F.lit(2.0**64)) + F.lit(0.5)
    # a row of size s stands for max(s, total / wanted) bytes
    drawn = rows.where(luck < chance).select("h", "tie", F.greatest("size", F.lit(int(1 / rate) if rate else 1)).cast("long").alias("weight"))
    return np.array([tuple(r) for r in drawn.collect()], np.int64).reshape(-1, 3)


def shard_by_bytes(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", ranges_per_shard: int = 32, draws_per_range: int = 16, whole_group: float = 0.005) -> DataFrame:
    """Range-partitions documents into ``shards`` of nearly equal bytes by the key (hash of the text, doc_id).

    One row per document: doc_id, size (UTF-8 bytes and 1; a null text has 1), text_crc32 (of a null text: of no
    bytes), law 'bytes', shard, slot (place in the shard, gapless from 0), grown_shard null. Documents with equal text
    are neighbours in key order and share a shard, unless their bytes exceed ``whole_group`` of a shard: such a group
    is split by doc_id where the balance asks for it. Rows without a doc_id come first among equal texts; rows that are
    equal in all columns take neighbouring slots; an empty table gives no rows.

    Splitters are quantiles of a size-weighted sample of at most about shards x ranges_per_shard x draws_per_range
    keys; a range over twice its due is subdivided by splitters drawn from it alone. Totals per range are exact, so
    the shard of a row follows from exact running bytes.
    """
    keyed = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("tie"),
        )
    )
    total, rows = (int(x or 0) for x in keyed.agg(F.sum("size"), F.count(F.lit(1))).first())
    ranges = shards * ranges_per_shard
    splitters = weighted_splitters(draw(keyed, ranges * draws_per_range, total), ranges)
    for _ in range(2):
        ranged = in_ranges(keyed, splitters)
        sums = ranged.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))
        due = max(total / ranges, 1)
        # a range of one large document can't be divided
        overfull = sums.where((F.col("bytes") > 2 * due) & (F.col("bytes") > 2 * F.col("largest")))
        sample = draw(ranged.join(F.broadcast(overfull.select("range_id")), "range_id", "left_semi"), ranges * draws_per_range, total)  # at most one row per range
        if not len(sample):
            break
        parts = max(2, int(2 * sample[:, 2].sum() / due))
        wider = np.unique(np.concatenate([splitters, weighted_splitters(sample, parts)]), axis=0)
        if len(wider) == len(splitters):
            break
        splitters = wider
    ranged = in_ranges(keyed, splitters)
    order = Window.partitionBy("range_id").orderBy("h", "tie", "size")
    all_before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # over at most a few thousand ranges
    offsets = ranged.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("range_id", F.coalesce(F.sum("bytes").over(all_before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("rows_before"))
    placed = (
        ranged.withColumns({"run": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(order) - 1})
        .join(offsets, "range_id")
        .select("doc_id", "size", "text_crc32", "h", (F.col("run") + F.col("bytes_before")).alias("at"), (F.col("nth") + F.col("rows_before")).alias("nth"))
    )
    placed = cut(placed)
    target = max(total, 1) / shards
    groups = placed.groupBy("h").agg(F.sum("size").alias("group_bytes"), F.min("at").alias("group_at"), F.count(F.lit(1)).alias("copies"))
    groups = groups.where((F.col("copies") > 1) & (F.col("group_bytes") <= F.lit(whole_group * target)))
    unit_at, unit_size = F.coalesce("group_at", "at"), F.coalesce("group_bytes", "size")
    shard = F.least(F.floor((unit_at + unit_size / 2) / F.lit(target)), F.lit(shards - 1)).cast("int")
    dealt = placed.join(groups, "h", "left").select("doc_id", "size", "text_crc32", "nth", shard.alias("shard"))
    firsts = dealt.groupBy("shard").agg(F.min("nth").alias("first"))
    return dealt.join(F.broadcast(firsts), "shard").select(  # at most `shards` rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
