"""Packing documents into sequences of bounded length by best-two-fit."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.llm.columns import cut, ranked, with_text_columns
from spendloom.llm.token_counts import compiled, read_spec

PIECES = T.ArrayType(
    T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in the bin, how many such bins), given counts[length] of pieces of each length.

    A bin opens with the longest piece left and is filled greedily with the longest that fits. Then its smallest piece
    is replaced, as long as that leaves less room, by the two unpacked pieces that fill the expanded gap best. The same
    bin is repeated as often as the counts allow, so the work depends on the number of lengths, not of pieces.
    """
    left = counts.astype(np.int64).copy()
    bins = []
    while left.any():
        free = left.copy()
        opening = int(np.flatnonzero(free)[-1])
        free[opening] -= 1
        content, gap = [opening], capacity - opening
        while True:
            fit = np.flatnonzero(free[: gap + 1])
            if not fit.size:
                break
            n = int(fit[-1])
            free[n] -= 1
            content.append(n)
            gap -= n
        while gap and len(content) > 1:
            smallest = content[-1]
            room = gap + smallest
            lengths = np.flatnonzero(free[: room + 1])
            if not lengths.size:
                break
            # for each a, the longest b <= room - a; a piece pairs with its own length only if two are left
            at = np.searchsorted(lengths, room - lengths, side="right") - 1
            same = (at >= 0) & (lengths[at] == lengths) & (free[lengths] < 2)
            at = at - same
            total = np.where(at >= 0, lengths + lengths[at], 0)
            best = int(total.argmax())
            if total[best] <= smallest:
                break
            a, b = int(lengths[best]), int(lengths[at[best]])
            free[smallest] += 1
            free[a] -= 1
            free[b] -= 1
            content = sorted([*content[:-1], a, b], reverse=True)
            gap = capacity - sum(content)
        used = Counter(content)
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        bins.append((content, times))
    return bins


def seats(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): where the pieces of a length go, in order of their rank."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for content, times in bins:
        offset = 0
        for n in content:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def document_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of the token ids of each text with ``end_id`` after them."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def make():
        tokenizer = compiled(spec.value)

        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            ids, bounds = tokenizer.encode(data, offsets)
            rows: list[tuple[int, int, int, int]] = []
            ends = [0]
            end = np.array([end_id], "<u4").tobytes()
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = ids[low:high].astype("<u4").tobytes() + end
                n = high - low + 1
                first = n % capacity or capacity if n > capacity else n
                rows.append((0, 0, first, zlib.crc32(own[: 4 * first])))
                for k, start in enumerate(range(first, n, capacity), 1):
                    rows.append((k, start, capacity, zlib.crc32(own[4 * start : 4 * (start + capacity)])))
                ends.append(len(rows))
            a = np.array(rows, np.int64).reshape(-1, 4)
            parts = [pa.array(a[:, 0], pa.int32()), *(pa.array(a[:, k], pa.int64()) for k in (1, 2, 3))]
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["piece", "start", "length", "ids_crc32"]))]

        return compute

    listed = with_text_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", [T.StructField("pieces", PIECES)], make)
    return listed.select("doc_id", F.inline("pieces"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Puts every document into sequences of at most ``capacity`` tokens, in as few of them as best-two-fit needs.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its token ids and
    ``end_id``; one longer than ``capacity`` is cut, its first piece taking what is over. A null or empty text is
    ``end_id`` alone; repeated rows are packed each; an empty table gives no rows; a null doc_id stays null.

    Only the counts of the lengths (at most ``capacity`` numbers) reach the driver; the bins it plans from them are
    patterns of lengths with a multiplicity, whose number depends on ``capacity`` alone. Pieces then find their seat
    by their rank among those of their length, which is counted in slices, so a length that a third of all pieces
    share is dealt over many tasks.
    """
    pieces = cut(document_pieces(docs, vocabulary, capacity, end_id, text, doc_id).withColumn("key", F.xxhash64("doc_id", "piece", "start", "ids_crc32")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    plan = seats(best_two_fit(counts, capacity))
    # (length, rank) as one number, to be searched
    wide = int(counts.max(initial=0)) + 1
    starts = plan[:, 0] * wide + plan[:, 1]
    placed = ranked(pieces, ["length"], "key", ["doc_id", "piece"], None, int(counts.sum()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([*(placed.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def seat(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length * wide + rank, side="right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])], names=schema.names)

    return placed.select(*names, "rank").mapInArrow(seat, schema)
