"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendloom.llm.columns import cut, fresh, is_blank, named, slices_of, with_text_columns, word_bounds


def water_fill(sizes: list[int], weights: list[int], total: int, repeats: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``repeats`` times its size; what is over is shared again by weight."""
    target = [Fraction(0)] * len(sizes)
    open_, left = {k for k, n in enumerate(sizes) if n > 0}, Fraction(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] > repeats * sizes[k] * weight}
        if not full:
            for k in open_:
                target[k] = left * weights[k] / weight
            break
        for k in full:
            target[k] = Fraction(repeats * sizes[k])
        left -= sum(target[k] for k in full)
        open_ -= full
    return [float(x) for x in target]


def min_cost_flow(supply: list[int], member: list[list[int]], quota: list[int], repeats: int) -> np.ndarray:
    """Words that each membership pattern gives to each source: flow[pattern, source].

    A pattern can give its words up to ``repeats`` times, the first time at cost 0, each further time at one more.
    Cheapest paths are augmented until no quota can be served further; the costs are convex, so that is the cheapest
    way to serve as much as can be served.
    """
    p, s = len(supply), len(quota)
    source, sink = p + s, p + s + 1
    graph: list[list[int]] = [[] for _ in range(p + s + 2)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)

    for k, n in enumerate(supply):
        for r in range(repeats):
            edge(source, k, n, r)
    links = {}
    for k, members in enumerate(member):
        for m in members:
            links[k, m] = len(to)
            edge(k, p + m, repeats * supply[k], 0)
    for m, n in enumerate(quota):
        edge(p + m, sink, n, 0)
    height = [0] * len(graph)
    while True:
        far: dict[int, int] = {source: 0}
        via: dict[int, int] = {}
        queue = [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e]:
                    y, nd = to[e], d + cost[e] + height[x] - height[to[e]]
                    if nd < far.get(y, 1 << 62):
                        far[y], via[y] = nd, e
                        heapq.heappush(queue, (nd, y))
        if sink not in far:
            break
        most = max(far.values())
        height = [h + far.get(x, most) for x, h in enumerate(height)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    flow = np.zeros((p, s), np.int64)
    for (k, m), e in links.items():
        flow[k, m] = room[e ^ 1]
    return flow


def with_sizes(docs: DataFrame, text: str, sources: str, doc_id: str, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its size (words), names (its sources, sorted), pattern of these and key (a seeded hash), and the
    names of these columns."""
    name = {c: fresh(docs, c) for c in ("size", "names", "pattern", "key")}
    several = isinstance(docs.schema[sources].dataType, T.ArrayType)
    own = named(sources)
    names = F.array_sort(F.array_distinct(own)) if several else F.array(own)
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string"))) if several else names
    blank = is_blank()

    def make():
        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            _, _, first = word_bounds(data, offsets, blank)
            return [np.diff(first).astype(np.int64)]

        return compute

    sized = with_text_columns(docs, text, [T.StructField(name["size"], T.LongType())], make, keep=True)
    pattern = F.to_json(F.struct(names.alias("names")), {"ignoreNullFields": "false"})
    return sized.withColumns({name["names"]: names, name["pattern"]: pattern, name["key"]: F.xxhash64(F.lit(seed), named(doc_id), named(name["size"]))}), name


def mixing_plan(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """For each membership pattern: source_size, target, ``whole`` and ``cut``. A document of the pattern is taken
    ``whole`` times, and once more if its key is at most ``cut``. ``sized`` has pattern, names, size and key."""
    patterns = sized.groupBy("pattern").agg(F.first("names").alias("names"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    ordered = sorted({x for r in patterns for x in r["names"]}, key=lambda x: (x is None, x or ""))
    place = {x: k for k, x in enumerate(ordered)}
    member = [[place[x] for x in r["names"]] for r in patterns]
    supply = [int(r["size"]) for r in patterns]
    sizes = [sum(n for n, m in zip(supply, member, strict=True) if k in m) for k in range(len(ordered))]
    target = water_fill(sizes, [weights[k % len(weights)] for k in range(len(ordered))], sum(supply), repeats)
    flow = min_cost_flow(supply, member, [round(x) for x in target], repeats)
    rows = [
        (r["pattern"], sum(sizes[k] for k in m), float(sum(target[k] for k in m)), int(given // n) if n else 0, int(given % n) if n else 0)
        for r, m, n, given in zip(patterns, member, supply, flow.sum(axis=1).tolist(), strict=True)
    ]
    quota = sized.sparkSession.createDataFrame(rows, "pattern string, source_size long, target double, whole int, rest long")
    # the slice in which the running words of a pattern pass the rest, then the row
    piece, sums = slices_of(sized, ["pattern"], "key", "size", sum(int(r["n"]) for r in patterns))
    edge = sums.join(quota, "pattern").where((F.col("weight_before") < F.col("rest")) & (F.col("weight_before") + F.col("slice_weight") >= F.col("rest")))
    edge = edge.groupBy("pattern").agg(F.min_by(F.struct("slice", "weight_before", "rest"), "slice").alias("e")).select("pattern", "e.*")
    near = sized.withColumn("slice", piece).join(edge, ["pattern", "slice"])
    # rows with one key (repeated rows) count as one step
    steps = near.groupBy("pattern", "key").agg(F.sum("size").alias("size"), F.first("weight_before").alias("weight_before"), F.first("rest").alias("rest"))
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight_before")
    steps = steps.withColumn("run", run)
    cuts = steps.groupBy("pattern").agg(
        # nearest to the rest: some key of the slice, or none of them
        F.min_by(F.struct("key", "run"), F.struct(F.abs(F.col("run") - F.col("rest")), "key")).alias("best"), F.min("key").alias("first_key"), F.min("weight_before").alias("low"), F.first("rest").alias("rest")
    )
    cuts = cuts.select("pattern", F.when(F.abs(F.col("best.run") - F.col("rest")) <= F.col("rest") - F.col("low"), F.col("best.key")).otherwise(F.col("first_key") - 1).alias("cut"))
    return quota.join(cuts, "pattern", "left").select("pattern", "source_size", "target", "whole", "cut")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: int = 17, text: str = "text", sources: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """How often each document is taken so that the sources come to their target weights.

    ``sources`` is a string column or, where sources overlap, an array of strings. One row per document: doc_id, size
    (words), source_size and target (of its source; of several, their sums), taken (words, repeats counted). Sources
    in order of code points, null last, weigh ``weights`` in turn and share the words of all documents; a target stops
    at ``repeats`` times its source's words. A null or empty text has size 0 and is taken 0 words. An empty array is
    the null source. An empty table gives no rows. Equal rows are taken alike or not at all.

    Documents are counted by membership pattern; patterns and sources (a table of names, not of documents) go to the
    driver, which routes words from patterns to quotas by min-cost flow, a repeat costing more each time. A pattern
    whose flow is q times its words takes every document floor(q) times and, once more, those whose seeded hash lies
    under a cut, where the words come nearest to the rest. Cuts come from sums over slices of the hash, so a pattern
    that holds a third of all documents is dealt over many tasks.
    """
    docs = docs.select(named(doc_id).alias("doc_id"), named(sources).alias("source"), named(text).alias("text"))
    sized = cut(with_sizes(docs, "text", "source", "doc_id", seed)[0].select("doc_id", "size", "pattern", "names", "key"))
    decided = sized.join(mixing_plan(sized, weights, repeats), "pattern")
    times = F.col("whole") + F.coalesce((F.col("key") <= F.col("cut")).cast("int"), F.lit(0))
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: int = 17, text: str = "text", sources: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` takes it, in the same columns.

    Whether a row is taken follows from its own key and its pattern's cut, so texts are not shuffled.
    """
    narrow = docs.select(named(doc_id).alias("doc_id"), named(sources).alias("source"), named(text).alias("text"))
    narrow = cut(with_sizes(narrow, "text", "source", "doc_id", seed)[0].select("size", "pattern", "names", "key"))
    plan = cut(mixing_plan(narrow, weights, repeats))
    sized, name = with_sizes(docs, text, sources, doc_id, seed)
    at = fresh(sized, "plan")
    joined = sized.join(plan.select(F.col("pattern").alias(f"{at}_pattern"), F.struct("whole", "cut").alias(at)), named(name["pattern"]) == F.col(f"{at}_pattern"))
    times = F.col(at)["whole"] + F.coalesce((named(name["key"]) <= F.col(at)["cut"]).cast("int"), F.lit(0))
    taken = joined.withColumn(fresh(joined, "times"), times).where((times > 0) & (named(name["size"]) > 0))
    return taken.withColumn(fresh(taken, "copy"), F.explode(F.sequence(F.lit(1), times))).select(*(named(c) for c in docs.columns))
