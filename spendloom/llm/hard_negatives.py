"""Hard negatives by exact search in cover trees over norm-augmented vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.llm.columns import cut, named
from spendloom.llm.nearest import BROADCAST_LENGTHS
from spendloom.llm.vectors import matrix

#: Scores stay below this, so that a hundredfold of one fits 64 bits.
SCORE_BOUND = 1 << 56
#: Products whose sums stay below this are exact in float64.
EXACT = 1 << 53


def augmented(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one component more, sqrt(top - |v|^2), so that all have the squared length ``top``: then a larger
    inner product with a query is a smaller distance from the query with 0 as its last component."""
    square = np.einsum("nd,nd->n", v, v)
    return np.concatenate([v, np.sqrt(np.maximum(0, top - square))[:, None]], axis=1)


def bounds(q: np.ndarray, centers: np.ndarray, radius: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[center, query] lower and upper bounds of the inner products with what lies within ``radius`` of a center, and
    the product with the center itself; widened by more than the rounding of the distances."""
    square = np.einsum("nd,nd->n", q, q)
    middle = centers[:, :-1] @ q.T
    length = np.einsum("nd,nd->n", centers, centers)[:, None]
    d = np.sqrt(np.maximum(0, square + length - 2 * middle))
    whole = square + top
    slack = 1e-7 * whole + 1
    near = np.maximum(0, d - radius[:, None])
    return (whole - (d + radius[:, None]) ** 2) / 2 - slack, (whole - near**2) / 2 + slack, middle


class CoverTree:
    """Points in nested balls. A node's children are centers picked farthest first, the node's own center among them,
    until every point lies within half the node's radius of one, or there are ``fanout``; each child keeps the largest
    distance that it really covers. Points are put in an order in which every node is a run of them."""

    def __init__(self, points: np.ndarray, leaf: int = 48, fanout: int = 16):
        self.order = np.arange(len(points))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        stack = [(0, len(points), 0, -1)] if len(points) else []
        while stack:
            low, high, center, parent = stack.pop()
            own = self.order[low:high]
            distance = np.sqrt(((points[own] - points[center]) ** 2).sum(axis=1))
            node = len(self.center)
            self.center.append(center)
            self.radius.append(float(distance.max()))
            self.span.append((low, high))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if high - low <= leaf or not self.radius[node] > 0:
                continue
            centers, nearest, goal = [center], np.zeros(len(own), np.int64), self.radius[node] / 2
            while len(centers) < fanout and distance.max() > goal:
                pick = own[int(distance.argmax())]
                other = np.sqrt(((points[own] - points[pick]) ** 2).sum(axis=1))
                nearest[other < distance] = len(centers)
                distance = np.minimum(distance, other)
                centers.append(pick)
            by = np.argsort(nearest, kind="stable")
            self.order[low:high] = own[by]
            ends = low + np.searchsorted(nearest[by], np.arange(len(centers) + 1))
            stack += [(int(ends[k]), int(ends[k + 1]), centers[k], node) for k in range(len(centers)) if ends[k] < ends[k + 1]]
        self.spheres = points[self.center] if len(points) else points
        self.radius = np.array(self.radius)


class Windows:
    """What each query wants: up to W windows of scores, the k best (score, smaller vec_id) of each. ``need`` is what a
    score has to reach to count; it rises as windows fill up."""

    def __init__(self, wants: list[list[dict]], k: int):
        w = max(map(len, wants), default=0)
        self.k = k
        self.low, self.high, self.need = np.ones((len(wants), w), np.int64), np.zeros((len(wants), w), np.int64), np.ones((len(wants), w), np.int64)
        for i, row in enumerate(wants):
            for j, x in enumerate(row):
                self.low[i, j], self.high[i, j] = x["low"], x["high"]
                self.need[i, j] = x["low"] if x["least"] is None else max(x["low"], x["least"])
        # windows that a query does not have are never met
        self.unused = self.low > self.high
        self.need[self.unused] = SCORE_BOUND
        self.slot, self.score, self.vec_id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Takes scores of slots (query * W + window) in, keeps the best of each and raises what is needed."""
        slot, score, vec_id = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.k
        self.slot, self.score, self.vec_id = slot[kept], score[kept], vec_id[kept]
        full = place == self.k - 1
        need = self.need.reshape(-1)
        need[slot[full]] = np.maximum(need[slot[full]], score[full])


def descend(tree: CoverTree, sides: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray, np.ndarray], windows: Windows, same: bool) -> int:
    """Best first, for many queries at once; gives the number of scores that were computed.

    A leaf's bounds are the tightest of all nodes above it. Each query opens its leaves in the order of the largest
    product that they may hold inside the windows, the first two, then twice as many in each round; a leaf that lies
    outside all windows, or below what a window has by then, is never opened. The queries that open a leaf in the same
    round meet its rows in one product. ``sides``: lower and upper bounds and centers' products [node, query]; ``rows``
    and ``queries``: vectors, ids and labels.
    """
    lower, upper, middle = sides
    for node, children in enumerate(tree.children):
        for child in children:
            lower[child], upper[child] = np.maximum(lower[child], lower[node]), np.minimum(upper[child], upper[node])
    leaves = np.array([node for node, children in enumerate(tree.children) if not children])
    lower, upper, middle = lower[leaves], upper[leaves], middle[leaves]
    highest = windows.high.max(axis=1, initial=-SCORE_BOUND).astype(np.float64)
    order = np.lexsort((-middle, -np.minimum(upper, highest)), axis=0)
    (v, ids, labels), (q, own, label) = rows, queries
    done, first, step = 0, 0, 2
    while first < len(leaves):
        leaf, who = order[first : first + step], np.arange(len(q))[None, :]
        # [leaf, query, window]: whether a leaf may still hold something
        may = ((upper[leaf, who][..., None] >= windows.need) & (lower[leaf, who][..., None] <= windows.high) & ~windows.unused).any(axis=2)
        place, who = np.nonzero(may)
        leaf = leaf[place, who]
        first, step = first + step, 2 * step
        if not len(leaf):
            continue
        by = np.argsort(leaf, kind="stable")
        leaf, who = leaf[by], who[by]
        starts = np.flatnonzero(np.diff(leaf, prepend=-1))
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        for at, end in zip(starts, [*starts[1:], len(leaf)], strict=True):
            low, high = tree.span[leaves[leaf[at]]]
            some = who[at:end]
            score = v[low:high] @ q[some].T
            done += score.size
            fit = ((labels[low:high, None] == label[some]) == same) & (ids[low:high, None] != own[some])
            score = np.where(fit, score, -SCORE_BOUND).astype(np.int64)
            hit = (score[..., None] >= windows.need[some]) & (score[..., None] <= windows.high[some])
            r, c, w = np.nonzero(hit)
            for x, y in zip(found, (some[c] * windows.need.shape[1] + w, score[r, c], ids[low:high][r]), strict=True):
                x.append(y)
        windows.offer(*map(np.concatenate, found))
    return done


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """Vectors in which sums of products are exact: float64 where they stay below 2^53, else 64-bit integers."""
    largest = int(np.abs(v).max(initial=0))
    if largest * largest * v.shape[1] >= SCORE_BOUND:
        raise ValueError("scores of 2^56 and more are not handled; scale the vectors down")
    return v if largest * largest * v.shape[1] < EXACT else v.astype(np.int64)


def cells_of(batches: Iterator[pa.RecordBatch], centers: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, dim, top, v) with their nearest center and its distance; -1, the origin, where a length has
    no centers."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d))
            x = augmented(matrix(part.column(4)).reshape(len(part), d), float(part.column(3)[0].as_py()))
            own = centers.get(d)
            if own is None:
                cell, distance = np.full(len(x), -1), np.sqrt(np.einsum("nd,nd->n", x, x))
            else:
                square = np.einsum("nd,nd->n", own, own)
                cell = np.concatenate([(square - 2 * (x[k : k + 4096] @ own.T)).argmin(axis=1) for k in range(0, len(x), 4096)])
                distance = np.sqrt(((x - own[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], names=[*part.schema.names, "cell", "distance"])


def promising(batches: Iterator[pa.RecordBatch], centers: dict[int, np.ndarray], first: int, rest: bool) -> Iterator[pa.RecordBatch]:
    """The cells that queries (anchor_id, label, dim, top, v, wants, balls) have to visit: the ``first`` ones of largest
    product within the windows, or with ``rest`` the others that may still hold something."""
    for batch in batches:
        visit: list[list[int]] = []
        for row in batch.select(["dim", "top", "v", "wants", "balls"]).to_pylist():
            d, top, wants = row["dim"], float(row["top"]), row["wants"]
            cell = np.array([b["cell"] for b in row["balls"]])
            own = centers[d][cell] if d in centers else np.zeros((len(cell), d + 1))
            lower, upper, middle = (x[:, 0] for x in bounds(np.array(row["v"], float).reshape(1, d), own, np.array([b["radius"] for b in row["balls"]]), top))
            low = np.array([w["low"] if w["least"] is None else max(w["low"], w["least"]) for w in wants])
            high = np.array([w["high"] for w in wants])
            may = ((upper[:, None] >= low) & (lower[:, None] <= high)).any(axis=1)
            floor = np.array([w["low"] for w in wants])
            open_ = ((upper[:, None] >= floor) & (lower[:, None] <= high)).any(axis=1)
            order = np.lexsort((cell, np.abs(middle - min(float(high.max()), top)), ~open_))
            chosen = order[:first][open_[order[:first]]]
            if rest:
                may[chosen] = False
                chosen = np.flatnonzero(may)
            visit.append(cell[chosen].tolist())
        keep = [k for k, name in enumerate(batch.schema.names) if name != "balls"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(visit, pa.list_(pa.int32()))], names=[*(batch.schema.names[k] for k in keep), "cells"])


WANT = T.StructType([T.StructField("positive_id", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("least", T.LongType())])
FOUND = "anchor_id long, positive_id long, block int, best array<struct<minus: long, vec_id: long>>"


def searched(same: bool, k: int):
    """A function for a block of queries and a block of rows: the k best of each window, of the same label or others."""

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        anchor, label, wants = left.column("anchor_id").to_numpy(), left.column("label").to_numpy(), left.column("wants").to_pylist()
        block = hash(tuple(x.as_py() for x in key)) & 0x7FFFFFFF
        windows = Windows(wants, k)
        if len(anchor) and len(right):
            d, top = int(right.column("dim")[0].as_py()), float(right.column("top")[0].as_py())
            v, q = matrix(right.column("v")).reshape(len(right), d), matrix(left.column("v")).reshape(len(left), d)
            tree = CoverTree(augmented(v, top))
            sides = bounds(q, tree.spheres, tree.radius, top)
            both = whole_numbers(np.concatenate([v, q]))
            v, q = both[: len(v)][tree.order], both[len(v) :]
            descend(tree, sides, (v, right.column("vec_id").to_numpy()[tree.order], right.column("label").to_numpy()[tree.order]), (q, anchor, label), windows, same)
        slot, starts = np.unique(windows.slot, return_index=True)
        each = pa.StructArray.from_arrays([pa.array(-windows.score), pa.array(windows.vec_id)], names=["minus", "vec_id"])
        best = pa.ListArray.from_arrays(pa.array(np.append(starts, len(windows.slot)), pa.int32()), each)
        width = max(1, windows.need.shape[1])
        positive = pa.array([wants[i][w]["positive_id"] for i, w in zip((slot // width).tolist(), (slot % width).tolist(), strict=True)], pa.int64())
        return pa.table({"anchor_id": pa.array(anchor[slot // width].astype(np.int64)), "positive_id": positive, "block": pa.array(np.full(len(slot), block), pa.int32()), "best": best})

    return compare


class Search:
    """Rows dealt into cells around sampled centers and into blocks; answers windows of queries against all of them."""

    def __init__(self, rows: DataFrame, block_rows: int, block_queries: int, cells: int, sample: int, first: int):
        self.block_rows, self.block_queries, self.first = block_rows, block_queries, first
        shapes = cut(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top")))
        self.few = shapes.count() <= BROADCAST_LENGTHS
        rows = rows.join(self.maybe(shapes.drop("n")), "dim").select("vec_id", "label", "dim", "top", "v")
        n = shapes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # a bounded sample: its rows of smallest hash
        taken = rows.orderBy(F.xxhash64(F.lit(7), "vec_id")).limit(sample).toPandas()
        self.centers: dict[int, np.ndarray] = {}
        for d, own in taken.groupby("dim"):
            x = augmented(np.array(own["v"].tolist(), np.float64).reshape(len(own), d), float(own["top"].iloc[0]))
            self.centers[int(d)] = farthest_first(x, max(1, min(cells, -(-n // block_rows))))
        centers = self.centers
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])
        self.rows = cut(rows.mapInArrow(lambda b: cells_of(b, centers), schema))
        self.balls = cut(self.rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")))
        self.shapes = shapes

    def maybe(self, df: DataFrame) -> DataFrame:
        """A table of a row for each length, to be broadcast if there are few."""
        return F.broadcast(df) if self.few else df

    def visits(self, asked: DataFrame, rest: bool) -> DataFrame:
        centers, first = self.centers, self.first
        # a row for each length, of at most as many balls as centers
        balls = self.balls.groupBy("dim").agg(F.collect_list(F.struct("cell", F.col("radius") * (1 + 1e-9) + 1e-6).cast("struct<cell: int, radius: double>")).alias("balls"))
        joined = asked.join(self.maybe(balls), "dim").select("anchor_id", "label", "dim", "top", "v", "wants", "balls")
        schema = T.StructType([*(f for f in joined.schema.fields if f.name != "balls"), T.StructField("cells", T.ArrayType(T.IntegerType()))])
        return joined.mapInArrow(lambda b: promising(b, centers, first, rest), schema)

    def meet(self, asked: DataFrame, rest: bool, same: bool, k: int) -> DataFrame:
        """One pass: the k best of each window in the cells of this pass."""
        cell = ["dim", "cell"]
        ask = self.visits(asked, rest).withColumn("cell", F.explode("cells")).drop("cells", "top")
        sizes = self.balls.select(*cell, F.ceil(F.col("n") / self.block_rows).cast("int").alias("blocks"))
        sizes = cut(ask.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / self.block_queries).cast("int").alias("parts")).join(sizes, cell))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda c, n: F.pmod(F.xxhash64(F.lit(5), c), F.col(n)).cast("int")
        ask = ask.join(sizes, cell).select(*cell, each("blocks").alias("block"), dealt("anchor_id", "parts").alias("part"), "anchor_id", "label", "v", "wants")
        held = self.rows.join(sizes, cell).select(*cell, dealt("vec_id", "blocks").alias("block"), each("parts").alias("part"), "vec_id", "label", "top", "v")
        group = [*cell, "block", "part"]
        return cut(ask.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(searched(same, k), FOUND))

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, positive_id, best) of all cells: the promising ones first, then the others that may still hold
        something better than what those gave."""
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        one = self.meet(asked, False, same, k)
        least = one.groupBy("anchor_id", "positive_id").agg(merged).where(F.size("best") == k).select("anchor_id", "positive_id", (-F.element_at("best", k)["minus"]).alias("least"))
        least = least.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("positive_id", F.lit(-1)), "least"))).alias("known"))
        again = asked.join(least, "anchor_id", "left").withColumn("wants", F.transform("wants", lambda w: w.withField("least", F.element_at("known", F.coalesce(w["positive_id"], F.lit(-1)))))).drop("known")
        two = self.meet(cut(again), True, same, k)
        both = one.unionByName(two)
        return both.groupBy("anchor_id", "positive_id", F.pmod("block", F.lit(64)).alias("part")).agg(merged).groupBy("anchor_id", "positive_id").agg(merged)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x``, each as far from the ones before as can be; fewer if the others equal one of them."""
    picked = [0]
    distance = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < n and distance.max() > 0:
        picked.append(int(distance.argmax()))
        distance = np.minimum(distance, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def hard_negatives(
    embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, block_rows: int = 4_096, block_queries: int = 512, cells: int = 256, sample: int = 4_096, first: int = 2,
) -> DataFrame:
    """Hard negatives of anchors: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the inner product of two such vectors, an exact integer. Anchors are
    the rows for which ``anchors`` holds. An anchor's positives are the ``positives`` other rows of its label with the
    highest scores; for each, the ``negatives`` rows of other labels with the highest scores between ``low_pct`` and
    ``high_pct`` percent of the positive's come out. Equal scores go by the smaller vec_id.

    Vectors get a component that makes them equally long, so a larger product is a smaller distance. Rows are dealt to
    the nearest of at most ``cells`` centers (farthest first in a sample of ``sample`` rows, which is all that the driver
    sees), and a cell's rows into blocks of about ``block_rows``, each a cover tree. A query first visits the ``first``
    most promising cells; then only those whose ball may still hold a score inside its windows that beats what it has.
    In a block queries descend best first. Bounds only skip what cannot count, so the result is exact; with vectors without
    structure few balls can be skipped, and the work is that of queries times rows, in blocks.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; zero vectors do.
    Only vectors of equal length meet. A vec_id that comes several times counts once, with its smallest (label,
    vector); rows that are equal but for the vec_id are each candidates. Scores of 2^56 and more are an error. An empty
    table gives no rows.
    """
    fine = F.forall(named(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(named(vector), lambda x: F.floor(x.cast("double") * scale))
    rows = embeddings.where(named(vec_id).isNotNull() & named(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(named(vec_id).cast("long").alias("vec_id"), named(label).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"), F.max("asks").alias("asks")).select("vec_id", "asks", "x.label", "x.v")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = cut(rows.select("vec_id", "asks", "label", "v", F.size("v").alias("dim"), square.alias("square")))
    search = Search(rows.drop("asks"), block_rows, block_queries, cells, sample, first)
    asked = rows.where("asks").join(search.maybe(search.shapes.drop("n")), "dim").select(F.col("vec_id").alias("anchor_id"), "label", "dim", "top", "v")
    asked = cut(asked)
    any_score = F.array(F.struct(F.lit(None).cast("long").alias("positive_id"), F.lit(-SCORE_BOUND).alias("low"), F.lit(SCORE_BOUND).alias("high"), F.lit(None).cast("long").alias("least")).cast(WANT))
    close = search.best(asked.withColumn("wants", any_score), True, positives)
    div = lambda x: F.call_function("div", x, F.lit(100))
    # a positive below zero has no window, nor has one without a whole number inside
    window = F.transform("best", lambda b: F.struct(b["vec_id"].alias("positive_id"), div(-b["minus"] * low_pct + 99).alias("low"), div(-b["minus"] * high_pct).alias("high"), F.lit(None).cast("long").alias("least")).cast(WANT))
    windows = close.select("anchor_id", "best", F.filter(F.zip_with("best", window, lambda b, w: F.when(b["minus"] <= 0, w)), lambda w: w.isNotNull() & (w["low"] <= w["high"])).alias("wants"))
    windows = cut(windows)
    found = search.best(asked.join(windows.where(F.size("wants") > 0).select("anchor_id", "wants"), "anchor_id"), False, negatives)
    scores = windows.select("anchor_id", F.explode("best").alias("b")).select("anchor_id", F.col("b.vec_id").alias("positive_id"), (-F.col("b.minus")).alias("positive_score"))
    ranked = found.select("anchor_id", "positive_id", F.posexplode("best").alias("at", "b"))
    return ranked.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("negative_id"), "positive_score", (-F.col("b.minus")).alias("negative_score")
    )


NEGATIVES_SQL = """
WITH u AS (SELECT vec_id, min(struct_pack(label := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, v := list_transform(embedding, lambda x: floor(256 * x::DOUBLE)))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
e AS (SELECT vec_id, x.label AS label, x.v AS v FROM u),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
