"""A vector index of lists around centers, with payload columns to filter by; top-k by cosine that leaves lists out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendloom.operators.retrieval import _best_of_slice
from spendloom.sources.shared import kept

#: Bounds are widened by this much for the rounding of distances.
SLACK = 1e-7


@dataclass
class VectorLists:
    """rows: (list, width, vec_id, embedding, norm, payload); centers by vector length; radius of each (width, list): the
    largest distance of a row, scaled to length one, from its center. Rows of a length without centers are in list -1."""

    rows: DataFrame
    centers: dict[int, np.ndarray]
    radius: dict[tuple[int, int], float]
    sizes: DataFrame


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centers(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centers of length one of a sample: a few rounds of spherical k-means from rows spread over it."""
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def vector_lists(vectors: DataFrame, payload: Sequence[str] = (), vec_id: str = "vec_id", embedding: str = "embedding", lists: int = 256, list_rows: int = 4096, sample: int = 16_384) -> VectorLists:
    """Deals vectors to the nearest of at most ``lists`` centers, about one for ``list_rows`` rows, fitted on a sample of
    ``sample`` rows (those of smallest hash); only these, the centers and a radius a list are with the driver. Every row
    is indexed; null and zero vectors and those with null components are left out."""
    square = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.size(embedding).alias("width"), F.sqrt(square).alias("norm"), *payload)
    rows = rows.where(F.col("norm") > 0)
    n = rows.count()
    taken = rows.select("vec_id", "embedding", "width").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    wanted = max(1, min(lists, -(-n // list_rows)))
    centers = {int(w): _centers(_unit(np.array(own["embedding"].tolist(), np.float64)), wanted) for w, own in taken.groupby("width")}
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == w))
                if w in centers:
                    x = _unit(_matrix(part.column("embedding"), w))
                    near = (x @ centers[w].T).argmax(axis=1)
                    distance = np.linalg.norm(x - centers[w][near], axis=1)
                else:
                    near, distance = np.full(len(part), -1), np.full(len(part), 2.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(distance)], names=schema.names)

    dealt = kept(rows.mapInArrow(deal, schema))
    sizes = kept(dealt.groupBy("width", "list").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")))
    # lists with centers are bounded in number; the others have no bound to keep
    radius = {(r["width"], r["list"]): r["radius"] for r in sizes.where(F.col("list") >= 0).collect()}
    return VectorLists(dealt.drop("distance"), centers, radius, sizes.select("width", "list", "n"))


def _visits(batches: Iterator[pa.RecordBatch], index: tuple[dict, dict], first: int, rest: bool) -> Iterator[pa.RecordBatch]:
    """The lists that queries (query_id, embedding, width, norm, least) visit: the ``first`` ones of largest bound, or with
    ``rest`` the others whose bound reaches ``least``."""
    centers, radius = index
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for w in np.unique(widths).tolist():
            part = batch.filter(pa.array(widths == w))
            own = [k for k in range(len(centers.get(w, ()))) if (w, k) in radius]
            if own:
                q = _unit(_matrix(part.column("embedding"), w))
                cosine = np.clip(q @ centers[w][own].T, -1, 1)
                gap = np.maximum(0, np.sqrt(np.maximum(0, 2 - 2 * cosine)) - np.array([radius[w, k] for k in own]) - SLACK)
                bound = 1 - gap * gap / 2 + SLACK
                order = np.lexsort((-cosine, -bound), axis=1)
                least = part.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
                chosen = [[own[j] for j in (o[first:] if rest else o[:first]) if not rest or b[j] >= t] for o, b, t in zip(order, bound, least, strict=True)]
            else:
                chosen = [[]] * len(part) if rest else [[-1]] * len(part)
            keep = ["query_id", "embedding", "width", "norm"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(chosen, pa.list_(pa.int32()))], names=[*keep, "lists"])


def nearest_in_lists(queries: DataFrame, index: VectorLists, k: int = 20, condition: Column | None = None, query_id: str = "query_id", embedding: str = "embedding", first: int = 4, slice_rows: int = 8192, max_queries: int = 2_000) -> DataFrame:
    """(query_id, vec_id, score, rank) of the ``k`` vectors nearest by cosine among those that meet ``condition`` (over the
    payload); ties go to the smaller id. Exact.

    The filter is applied to the lists before anything is compared. A query visits its ``first`` lists; the worst of the
    ``k`` found there says which of the others may still hold a nearer vector: the distance from a center less the
    list's radius bounds the cosine. Lists are met in slices of about ``slice_rows``, queries in blocks of about
    ``max_queries``.
    """
    square = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("embedding"), F.size(embedding).alias("width"), F.sqrt(square).alias("norm")).where(F.col("norm") > 0)
    asked = kept(asked)
    rows = (index.rows if condition is None else index.rows.where(condition)).select("width", "list", "vec_id", "embedding", "norm")
    tables = index.centers, index.radius
    key = ["width", "list", "slice", "block"]
    kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "vec_id": rows.schema["vec_id"].dataType.simpleString()}
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double"

    def meet(some: DataFrame, rest: bool) -> DataFrame:
        fields = T.StructType([*(some.schema[c] for c in ("query_id", "embedding", "width", "norm")), T.StructField("lists", T.ArrayType(T.IntegerType()))])
        visiting = some.mapInArrow(lambda b: _visits(b, tables, first, rest), fields).withColumn("list", F.explode("lists")).drop("lists")
        counted = visiting.groupBy("width", "list").agg(F.ceil(F.count(F.lit(1)) / max_queries).cast("int").alias("blocks"))
        parts = kept(counted.join(index.sizes, ["width", "list"]).select("width", "list", "blocks", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = visiting.join(parts, ["width", "list"]).select("width", "list", each("slices").alias("slice"), dealt("query_id", "blocks").alias("block"), "query_id", "embedding", "norm")
        right = rows.join(parts, ["width", "list"]).select("width", "list", dealt("vec_id", "slices").alias("slice"), each("blocks").alias("block"), "vec_id", "embedding", "norm")
        return kept(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _best_of_slice(k, a, b), schema))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = meet(asked.withColumn("least", F.lit(None).cast("double")), False)
    worst = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    two = meet(asked.join(worst, "query_id", "left"), True)
    return one.unionByName(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
