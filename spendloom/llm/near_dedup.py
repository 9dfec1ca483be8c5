"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.llm.columns import cut, fresh, named, of_ids, with_text_columns
from spendloom.llm.components import connected_components
from spendloom.llm.shingles import ShingleHasher, mix, odd_numbers, segment_min

LONGS = T.ArrayType(T.LongType())


def fixed_lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
    """Rows of ``values`` as lists for the texts that ``has`` marks, null for the others."""
    ends = np.concatenate([[0], np.cumsum(np.where(has, values.shape[1] if values.size else 0, 0))])
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def sketches(docs: DataFrame, collection: int, width: int) -> DataFrame:
    """(doc_id and others, n_shingles, set_a, set_b, left_keys, right_keys) of each text.

    set_a and set_b are sums of two hashes over the shingle set, the same for equal sets. left_keys and right_keys are
    the two small collections: ``collection`` keys each, a key made from ``width`` minhashes.
    """
    count = 2 * collection * width

    def make():
        hasher = ShingleHasher()
        factor, shift = odd_numbers(count, 3), odd_numbers(count, 4)
        pair = odd_numbers(width, 5)

        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            values, bounds = hasher.sets(data, offsets)
            n = np.diff(bounds)
            has = n > 0
            own = bounds[np.concatenate([has, [True]])] if has.any() else np.zeros(1, np.int64)
            sums = np.zeros((2, len(n)), np.uint64)
            keys = np.zeros((2 * collection, int(has.sum())), np.uint64)
            if has.any():
                sums[0, has] = np.add.reduceat(mix(values), own[:-1])
                sums[1, has] = np.add.reduceat(mix(values ^ shift[0]), own[:-1])
                for k in range(2 * collection):
                    key = np.full(keys.shape[1], k + 1, np.uint64)
                    for j in range(width):
                        f = k * width + j
                        key = mix(key + pair[j] * segment_min((values ^ shift[f]) * factor[f], own))
                    keys[k] = key
            return [
                n.astype(np.int64), sums[0].view(np.int64), sums[1].view(np.int64),
                fixed_lists(keys[:collection].T, has), fixed_lists(keys[collection:].T, has),
            ]

        return compute

    fields = [T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")] + [T.StructField(c, LONGS) for c in ("left_keys", "right_keys")]
    return with_text_columns(docs, "text", fields, make)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full set of each text, sorted."""

    def make():
        hasher = ShingleHasher()

        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            values, bounds = hasher.sets(data, offsets)
            return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))]

        return compute

    return with_text_columns(docs, "text", [T.StructField("shingles", LONGS)], make)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets have 100 * intersection >= ``percent`` * union."""
    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


class Forest:
    """Union-find over local indexes that remembers the links which joined two trees."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.links: list[tuple[int, int]] = []

    def top(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.root[y] = x
            self.links.append((a, b))


def links_across(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and ``right``, as a spanning forest over both; right ones are numbered on."""
    forest = Forest(len(left) + len(right))
    size = np.array([len(x) for x in right])
    _, local = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cuts = np.cumsum([len(x) for x in left])
    own, other = np.split(local[: cuts[-1]], cuts[:-1]), local[cuts[-1] :]
    starts = np.cumsum(size) - size
    flag = np.zeros(int(local.max()) + 1, np.int32)
    for k, x in enumerate(own):
        flag[x] = 1
        shared = np.add.reduceat(flag[other], starts)
        flag[x] = 0
        for y in np.flatnonzero(100 * shared >= percent * (len(x) + size - shared)):
            forest.join(k, len(left) + int(y))
    return forest.links


def links_left(groups: DataFrame, sets: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Links (a, b) between members of a group (l, rep, component_id) that are in different components so far.

    Members outside the component of the group's smallest id are its strays; each block of strays meets each block of
    members in one task, which returns a spanning forest of the links it finds. Groups with the same members are one.
    """
    kinds = groups.groupBy("l").agg(F.min_by("component_id", "rep").alias("major"), F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sign"))
    total = groups.count()
    strays = groups.join(kinds, "l").where("component_id <> major").groupBy("l").agg(F.count(F.lit(1)).alias("strays"))
    kinds = kinds.join(strays, "l").groupBy("sign", "members", "strays").agg(F.min(F.struct("l", "major")).alias("k")).select("k.*", "members", "strays")
    kinds = kinds.select("l", "major", F.ceil(F.col("members") / block).cast("int").alias("nb"), F.ceil(F.col("strays") / block).cast("int").alias("ns"))
    tagged = groups.join(kinds, "l").withColumn("luck", F.xxhash64(F.lit(9), "rep"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    right = tagged.select("l", "rep", F.lit(False).alias("stray"), F.pmod("luck", "nb").cast("int").alias("b"), F.explode(count("ns")).alias("s"))
    left = tagged.where("component_id <> major").select("l", "rep", F.lit(True).alias("stray"), F.pmod("luck", "ns").cast("int").alias("s"), F.explode(count("nb")).alias("b"))
    rows = left.unionByName(right).join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")

    def compare(key, group):
        group = group.combine_chunks()
        ids, stray, names = group.column("rep").to_numpy(), group.column("stray").to_numpy(), group.column("l").to_numpy()
        column = group.column("shingles").combine_chunks()
        ends = column.offsets.to_numpy() - column.offsets.to_numpy()[0]
        flat = column.flatten().to_numpy()
        order = np.argsort(names, kind="stable")
        found = []
        for part in np.split(order, np.flatnonzero(np.diff(names[order])) + 1):
            one, two = part[stray[part]], part[~stray[part]]
            if len(one) and len(two):
                both = ids[np.concatenate([one, two])]
                found += [(both[x], both[y]) for x, y in links_across([flat[ends[k] : ends[k + 1]] for k in one], [flat[ends[k] : ends[k + 1]] for k in two], percent)]
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    # small groups share a task's call; blocks of a large one come alone or nearly so
    rows = rows.withColumn("part", F.pmod(F.xxhash64("l"), F.lit(max(1, total // 2000))))
    return rows.groupBy("part", "s", "b").applyInArrow(compare, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, percent: int = 75, collection: int = 10, width: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of 5-word shingles have 100 * intersection >= ``percent`` * union;
    component_id is the smallest doc_id that links reach, kept says whether it is the document's own.

    Equal sets are one class, found by grouping, and go on as the class's smallest doc_id. A class has two small
    collections of keys, each key made from ``width`` minhashes; table keys are all pairs of a left and a right key,
    so collection ** 2 tables cost only 2 * collection * width minhashes. Before pairs are formed, keys that no other
    class has are left out: a table key can't collide unless both its parts do. With J = 0.75 a pair of classes meets
    with chance (1 - (1 - J ** width) ** collection) ** 2 = 0.9995.

    In each bucket all classes are first compared with its smallest doc_id. Where that leaves different components
    among the classes of one left key, those outside the first component are compared with all of the key, in blocks
    that return a spanning forest. So no link between classes that met is lost, yet no bucket is expanded into its
    pairs. Every link is confirmed on full shingle sets.

    A null, empty or blank text has no shingles and is linked with nothing; one of under five words is one shingle.
    Rows without a doc_id are not linked: component_id null, kept false. Rows that share a doc_id are one document for
    linking only if their texts are equal; each row is returned. An empty table gives no rows.
    """
    return _decided(docs, percent, collection, width, text, doc_id).drop("variant")


def _decided(docs: DataFrame, percent: int, collection: int, width: int, text: str, doc_id: str) -> DataFrame:
    """The rows of ``near_duplicates`` with ``variant``, a hash of the text."""
    docs = docs.select(named(doc_id).alias("doc_id"), F.xxhash64(named(text)).alias("variant"), named(text).alias("text"))
    made = cut(sketches(docs, collection, width))
    live = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut(live.groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct("doc_id", "left_keys", "right_keys")).alias("r")).select("n_shingles", "set_a", "set_b", F.col("r.doc_id").alias("rep"), "r.left_keys", "r.right_keys"))

    def meeting(side: str, name: str) -> DataFrame:
        rows = classes.select("rep", "n_shingles", F.explode(side).alias(name))
        often = rows.groupBy(name).count().where("count > 1").select(name)
        return rows.join(often, name)

    keys = meeting("left_keys", "l").join(meeting("right_keys", "r").select("rep", "r"), "rep")
    keys = cut(keys.select(F.xxhash64("l", "r").alias("key"), "l", "rep", F.col("n_shingles").alias("n")))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = classes.select(F.col("rep").alias("leader"), F.col("n_shingles").alias("m"))
    near_size = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    star = keys.join(buckets.select("key", "leader"), "key").where("rep <> leader").select("leader", "rep", "n").distinct()
    star = cut(star.join(sizes, "leader").where(near_size).select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    met = keys.select("rep").distinct()
    sets = cut(shingle_sets(of_ids(docs.select("doc_id", "text"), met.select(F.col("rep").alias("doc_id")), "doc_id")))
    links = cut(verified(star, sets, percent))
    first = connected_components(links)
    # classes that share a left key but not yet a component
    groups = keys.select("l", "rep").distinct().join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    mixed = groups.groupBy("l").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low <> high").select("l")
    rest = cut(links_left(cut(groups.join(mixed, "l")), sets, percent))
    if not rest.isEmpty():
        first = connected_components(links.unionByName(rest))
    of_class = classes.select("n_shingles", "set_a", "set_b", "rep").join(first.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("n_shingles", "set_a", "set_b", F.coalesce("component_id", "rep").alias("component_id"))
    result = made.select("doc_id", "variant", "n_shingles", "set_a", "set_b").join(of_class, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "variant", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, percent: int = 75, collection: int = 10, width: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, and of rows with equal doc_id and text one; same columns.

    Rows without a doc_id stay. Rows with equal doc_id and different texts are decided each.
    """
    decided = cut(_decided(docs, percent, collection, width, text, doc_id))
    key, variant, of = fresh(docs, "__key"), fresh(docs, "__variant"), fresh(docs, "__of")
    own = docs.withColumn(variant, F.xxhash64(named(text)))
    same = (named(doc_id) == F.col(key)) & (F.col(variant) == F.col(of))
    pairs = lambda rows: rows.select(F.col("doc_id").alias(key), F.col("variant").alias(of))
    stay = own.join(pairs(decided.where("not kept and doc_id is not null")).distinct(), same, "left_anti")
    again = cut(pairs(decided.where("kept")).groupBy(key, of).count().where("count > 1").drop("count"))
    if not again.isEmpty():
        once = stay.join(again, same, "left_semi").dropDuplicates([doc_id, variant])
        stay = stay.join(again, same, "left_anti").unionByName(once)
    return stay.select(*(named(c) for c in docs.columns))
