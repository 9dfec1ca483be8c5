"""Near-duplicate vectors by range search on a robust-pruned flat graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.columns import cut, named
from spendloom.llm.components import connected_components
from spendloom.llm.vectors import matrix, usable, with_class_key

MAX_CENTERS = 4096  # of one level: bounds what a level broadcasts
MOST_COPIES = 3  # a shard is not cut where its vectors would be held so many times each, or more
PANEL = 6  # blocks that a task compares with each other, or with those of another panel


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def k_means(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit centers of ``sample`` (unit rows), from a start drawn by a seed."""
    r = np.random.default_rng(5)
    centers = sample[r.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        nearest = (sample @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            own = sample[nearest == c]
            if len(own) and np.linalg.norm(own.sum(0)) > 1e-9:
                centers[c] = own.sum(0)
        centers = unit(centers)
    return np.unique(centers, axis=0)


def near_cells(v: np.ndarray, centers: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest cell of each unit vector, and which cells may hold a vector within distance ``reach`` of it.

    A neighbour y of x in cell A lies on A's side of the plane between A and any B, and x is at most ``reach`` from y,
    so x's signed distance to each of those planes is at most ``reach``.
    """
    dots = v @ centers.T
    home = dots.argmax(axis=1)
    inside = np.ones(dots.shape, bool)
    for a in range(len(centers)):
        apart = np.linalg.norm(centers - centers[a], axis=1)
        apart[a] = 1.0
        beyond = ((dots - dots[:, [a]]) / apart).max(axis=1)
        inside[:, a] = beyond <= reach + 1e-9
    inside[np.arange(len(v)), home] = True
    return home, inside


def robust_prune(v: np.ndarray, rows: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours of ``rows``, at most ``degree`` each, from their candidates ``pool``; -1 fills up.

    The nearest candidate left is taken, and those that it is closer to than the row itself, by the factor alpha, go.
    """
    n = len(pool)
    vectors = v[pool]
    gap = np.maximum(0, 2 - 2 * (vectors @ v[rows][:, :, None])[:, :, 0])
    gap[pool == rows[:, None]] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    gap, pool = np.take_along_axis(gap, order, 1), np.take_along_axis(pool, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    alive = np.isfinite(gap)
    out = np.full((n, degree), -1, np.int64)
    at = np.arange(n)
    for k in range(degree):
        pick = alive.argmax(axis=1)
        has = alive[at, pick]
        if not has.any():
            break
        out[has, k] = pool[at, pick][has]
        between = np.maximum(0, 2 - 2 * (vectors @ vectors[at, pick][:, :, None])[:, :, 0])
        alive &= alpha * alpha * between > gap
        alive[at, pick] = False
    return out


def clusters(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Overlapping clusters of about ``size`` members: each vector is in those of its two nearest centers.

    A cluster that a crowd of alike vectors overfills is dealt into parts, so that none is above four times ``size``.
    """
    n = len(v)
    r = np.random.default_rng(n)
    count = max(2, -(-2 * n // size))
    centers = k_means(v[r.permutation(n)[: 16 * count]], count, 3)
    dots = v @ centers.T
    two = np.argpartition(-dots, min(1, len(centers) - 1), axis=1)[:, :2]
    out = []
    for c in range(len(centers)):
        own = r.permutation(np.flatnonzero((two == c).any(axis=1)))
        out += [np.sort(x) for x in np.array_split(own, -(-len(own) // (4 * size)))] if len(own) else []
    return out


def build_graph(v: np.ndarray, degree: int = 12, far: int = 6, pool: int = 40, size: int = 128, alpha: float = 1.2) -> list[np.ndarray]:
    """Adjacency lists: near neighbours, pruned in each overlapping cluster and united over the clusters, pruned far ones
    to travel by, and the reverse of both. Vectors are compared within clusters only."""
    n = len(v)
    if n <= degree:
        return [np.delete(np.arange(n), k) for k in range(n)]
    r = np.random.default_rng(n)
    low_precision = v.astype(np.float32)
    starts, ends = [], []

    def link(rows: np.ndarray, candidates: np.ndarray, most: int) -> None:
        for k in range(0, len(rows), 1024):
            own = rows[k : k + 1024]
            out = robust_prune(low_precision, own, candidates[k : k + 1024], most, alpha)
            r_, c_ = np.nonzero(out >= 0)
            starts.append(own[r_])
            ends.append(out[r_, c_])

    for members in clusters(v, size):
        near = low_precision[members] @ low_precision[members].T
        take = min(pool + 1, len(members))
        link(members, members[np.argpartition(-near, take - 1, axis=1)[:, :take]], degree)
    link(np.arange(n), r.integers(0, n, (n, 4 * far)), far)
    a, b = np.concatenate(starts), np.concatenate(ends)
    own = np.unique(a * n + b)
    edges = np.unique(np.concatenate([own, b * n + a]))
    lists = np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))
    chosen = np.split(own % n, np.searchsorted(own // n, np.arange(1, n)))
    # a node that very many point at keeps its own choice and as many of the others
    most = 4 * (2 * degree + far)
    return [x if len(x) <= most else np.unique(np.concatenate([chosen[k], r.choice(x, most, replace=False)])) for k, x in enumerate(lists)]


def medoids(v: np.ndarray, count: int = 8) -> np.ndarray:
    """The member nearest to the mean, then members far from those chosen."""
    first = int((v @ v.mean(axis=0)).argmax())
    chosen, best = [first], v @ v[first]
    for _ in range(min(count, len(v)) - 1):
        k = int(best.argmin())
        chosen.append(k)
        best = np.maximum(best, v @ v[k])
    return np.unique(chosen)


def range_search(v: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, threshold: float, slack: float, extra: int, block: int = 512, beam: int = 48) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query (an index of ``v``) the members found with cosine >= ``threshold``, and whether it met itself.

    Greedy: from the medoids, the best node of the beam not yet expanded is expanded, until the query has met itself
    and ``extra`` more nodes are expanded. Then range-expanding: every node found within ``slack`` is expanded until
    none is left. The walk is in single precision; what comes near the threshold is measured in double.
    """
    n = len(v)
    low_precision = v.astype(np.float32)
    table = np.full((n, max((len(x) for x in lists), default=1) or 1), -1, np.int64)
    for k, x in enumerate(lists):
        table[k, : len(x)] = x
    start = medoids(v)
    found: list[np.ndarray] = []
    met_self = np.zeros(len(queries), bool)
    for low in range(0, len(queries), block):
        ids = queries[low : low + block]
        q, rows = low_precision[ids], np.arange(len(ids))
        seen = np.zeros((len(ids), n), bool)
        near: list[np.ndarray] = []  # query * n + node of all that came within slack
        seen[:, start] = True
        node = np.tile(start, (len(ids), 1))
        sim = q @ low_precision[start].T
        done = np.zeros(node.shape, bool)
        left = np.full(len(ids), extra)
        active = rows
        while len(active):
            open_ = np.where(done, -np.inf, sim)
            best = open_.argmax(axis=1)
            more = np.isfinite(open_[np.arange(len(active)), best]) & (left > 0)
            if not more.all():
                active, node, sim, done, left, best = (x[more] for x in (active, node, sim, done, left, best))
                if not len(active):
                    break
            at = np.arange(len(active))
            done[at, best] = True
            nb = table[node[at, best]]
            r, w = np.nonzero((nb >= 0) & ~seen[active[:, None], nb])
            c = nb[r, w]
            seen[active[r], c] = True
            value = np.einsum("kd,kd->k", q[active[r]], low_precision[c])
            close = value >= slack
            near.append(active[r[close]] * n + c[close])
            fresh = np.full(nb.shape, -np.inf, np.float32)
            fresh[r, w] = value
            node, sim = np.concatenate([node, nb], axis=1), np.concatenate([sim, fresh], axis=1)
            done = np.concatenate([done, np.zeros(nb.shape, bool)], axis=1)
            if sim.shape[1] > beam:
                top = np.argpartition(-sim, beam, axis=1)[:, :beam]
                node, sim, done = (np.take_along_axis(x, top, axis=1) for x in (node, sim, done))
            left = left - seen[active, ids[active]]
        met_self[low : low + block] = seen[rows, ids]
        # the start nodes, and the query itself, from which a walk that missed it goes on
        near.append(rows * n + ids)
        r, w = np.nonzero(q @ low_precision[start].T >= slack)
        near.append(r * n + start[w])
        seen[rows, ids] = True
        frontier = np.unique(np.concatenate(near))
        reached = [frontier]
        while len(frontier):
            wide = []
            for at in range(0, len(frontier), 1 << 13):
                part = frontier[at : at + (1 << 13)]
                nb = table[part % n]
                pair = ((part // n)[:, None] * n + nb)[nb >= 0]
                pair = np.unique(pair[~seen[pair // n, pair % n]])
                seen[pair // n, pair % n] = True
                value = np.einsum("kd,kd->k", q[pair // n], low_precision[pair % n])
                wide.append(pair[value >= slack])
            frontier = np.concatenate(wide)
            reached.append(frontier)
        pair = np.concatenate(reached)
        exact = np.concatenate([np.einsum("kd,kd->k", v[ids[p // n]], v[p % n]) for p in np.array_split(pair, max(1, len(pair) >> 14))])
        pair = np.unique(pair[(exact >= threshold) & (pair % n != ids[pair // n])])
        found.extend(np.split(pair % n, np.searchsorted(pair // n, rows[1:])))
    return found, met_self


def worth_a_cut(sample: np.ndarray, centers: np.ndarray, reach: float, copies: float) -> bool:
    """Whether cells make a shard smaller without too many copies, by its sample; a row has ``copies`` before."""
    inside = near_cells(sample, centers, reach)[1]
    return len(centers) > 1 and inside.sum(axis=0).max() <= 0.9 * len(sample) and copies * inside.sum() <= MOST_COPIES * len(sample)


def shard_rows(classes: DataFrame, sizes: dict, copies: dict, sample_rows: int, shard_size: int, reach: float, level: int) -> tuple[DataFrame, set]:
    """Splits the shards in ``sizes`` (shard -> rows) that are worth it into cells, and names them; a row goes to every
    cell that may hold a neighbour."""
    names = sorted(sizes)
    per = {s: max(2, min(MAX_CENTERS // max(1, len(names)), -(-sizes[s] // shard_size))) for s in names}
    rates = {s: min(1.0, sample_rows * sizes[s] / max(1, sum(sizes.values())) / sizes[s]) for s in names}
    rate = classes.sparkSession.createDataFrame([(s, float(r)) for s, r in rates.items()], "s string, rate double")
    luck = F.xxhash64(F.lit(level), "rep") / F.lit(2.0**64) + F.lit(0.5)
    drawn = classes.join(F.broadcast(rate), F.col("shard") == F.col("s")).where(luck < F.col("rate")).select("shard", "embedding").collect()  # about sample_rows
    samples: dict[str, list] = {}
    for r in drawn:
        samples.setdefault(r["shard"], []).append(r["embedding"])
    units = {s: unit(np.array(x, np.float64)) for s, x in samples.items() if len(x) > 1}
    centers = {s: k_means(x, per[s]) for s, x in units.items()}
    centers = {s: c for s, c in centers.items() if worth_a_cut(units[s], c, reach, copies[s])}
    shared = classes.sparkSession.sparkContext.broadcast(centers)

    def work(batches):
        for batch in batches:
            shard = np.array(batch.column("shard").to_pylist(), object)
            for s in sorted(set(shard.tolist())):
                rows = np.flatnonzero(shard == s)
                part = batch.take(pa.array(rows))
                if s not in shared.value:
                    yield pa.RecordBatch.from_arrays(part.columns, names=part.schema.names)
                    continue
                home, inside = near_cells(unit(matrix(part.column("embedding"))), shared.value[s], reach)
                r, c = np.nonzero(inside)
                taken = part.take(pa.array(r))
                own = taken.column("home").to_numpy(zero_copy_only=False) & (home[r] == c)
                cols = [taken.column(k) for k in range(taken.num_columns)]
                cols[taken.schema.get_field_index("shard")] = pa.array([f"{s}.{k}" for k in c], pa.string())
                cols[taken.schema.get_field_index("home")] = pa.array(own)
                yield pa.RecordBatch.from_arrays(cols, names=taken.schema.names)

    return classes.mapInArrow(work, classes.schema), set(centers)


class Forest:
    """Which of some ids links have joined; the smallest id of a tree is its top."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.root = ids.tolist(), list(range(len(ids)))

    def top(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            if self.ids[a] > self.ids[b]:
                a, b = b, a
            self.root[b] = a

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, id of its top) of all that are not tops."""
        ids = np.array(self.ids, np.int64)
        tops = np.array([self.top(k) for k in range(len(ids))], np.int64)
        k = np.flatnonzero(tops != np.arange(len(ids)))
        return ids[k], ids[tops[k]]


#: What is known of a shard's search.
AUDITED = ("queries", "met_self", "links_true", "links_found", "passes")
OUT = "kind string, a long, b long, shard string, " + ", ".join(f"{c} long" for c in AUDITED)


def shard_result(links: tuple[np.ndarray, np.ndarray], forest: Forest, shard: str, audit: tuple[int, int, int, int, int]) -> pa.Table:
    """Rows of OUT: links counted for each query, edges of the forest, and one row of the audit."""
    a, b = forest.edges()
    k, e = len(links[0]), len(a)
    members, *counts = audit
    none = pa.nulls(k + e, pa.int64())
    cat = lambda *x: pa.concat_arrays([pa.array(y, pa.int64()) for y in x])
    columns = {"kind": pa.array(["links"] * k + ["edge"] * e + ["audit"]), "a": cat(links[0], a, [None]), "b": cat(links[1], b, [members]), "shard": pa.array([None] * (k + e) + [shard], pa.string())}
    return pa.table(columns | {c: pa.concat_arrays([none, pa.array([x], pa.int64())]) for c, x in zip(AUDITED, counts, strict=True)})


def near_duplicate_vectors(
    embeddings: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    sample_rows: int = 20_000, shard_size: int = 6_000, levels: int = 6, audit_every: int = 16, wanted_recall: float = 0.999, least_recall: float = 0.98,
) -> tuple[DataFrame, DataFrame]:
    """(result, audit). Result: vec_id, n_links, component_id, kept, one row per vector.

    Vectors of one label, which is not null, are linked if their cosine in double precision is at least ``threshold``.
    Null or zero vectors, those with null or non-finite components, and those without a label link with nothing; so do
    vectors of different lengths. Equal vectors of a label are one class, linked with each other and counted each.
    A null vec_id stays null and is not linked. An empty table gives no rows.

    A label over twice ``shard_size`` (what a task holds with ease) is dealt to cluster shards around centers fitted on about ``sample_rows`` vectors
    a level. These overlap, so that the shard a vector is at home in holds all its neighbours in range. A shard is not
    cut where MOST_COPIES would be passed, by its sample (without structure, vectors are in reach of most cells). What
    ``levels`` cuts don't bring to that size is dealt into blocks: each has its own graph, and pairs of blocks are
    compared by products, once for both sides, panels of PANEL blocks at a time: a vector is sent once for each panel of
    its shard. The audit names the largest block of a panel's task as its members. In a shard of any size, a graph is
    built on overlapping clusters: lists pruned in each are united, and then united over the vector's shards. Every
    vector is searched in its home shard, from the medoids, expanding the range. Each ``audit_every``-th query is
    compared with brute force over the shard; a shard under ``wanted_recall`` is searched again, four times as widely,
    at last by product. audit: shard, members, queries, met_self, links_true, links_found (by the graph in its first
    pass, before any wider search), passes (negative if the shard ended by product). It is an error if the first passes
    of all shards together found less than ``least_recall`` of the audited links. Links leave a shard as counts and as a spanning forest, never as all pairs of a group.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    rows = embeddings.select(named(vec_id).cast("long").alias("vec_id"), named(label).cast("string").alias("label"), named(vector).alias("embedding"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")
    rows = with_class_key(rows.withColumn("fit", fit), "embedding")
    classes = rows.where("fit").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    shard = F.concat_ws("/", F.col("label"), F.size("embedding").cast("string"))
    members = cut(classes.select("rep", "copies", "embedding", shard.alias("shard"), F.lit(True).alias("home")))
    of_class = cut(classes.select("label", "h1", "h2", "rep", "copies"))
    whole, overlapping = set(), False
    for level in range(levels):
        large = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("own"))
        large = large.where((F.col("n") > 2 * shard_size) & ~F.col("shard").isin(sorted(whole))).orderBy(F.desc("n"), "shard").limit(MAX_CENTERS // 2).collect()
        if not large:
            break
        parted, done = shard_rows(members, {r["shard"]: r["n"] for r in large}, {r["shard"]: r["n"] / max(1, r["own"]) for r in large}, sample_rows, shard_size, reach, level)
        whole |= {r["shard"] for r in large} - done
        if done:
            members, overlapping = cut(parted), True
    # what is still overfull is dealt into blocks
    blocks = cut(members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_size)).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = None if blocks.isEmpty() else members.join(F.broadcast(blocks), "shard", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0)).cast("int"))
    if dealt is not None:
        members = dealt.select("rep", "copies", "embedding", F.concat_ws("#", "shard", "block").alias("shard"), "home")

    def build(key, group):
        ids = group.column("rep").to_numpy()
        lists = build_graph(unit(matrix(group.column("embedding"))))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        flat = ids[np.concatenate(lists).astype(np.int64)] if len(lists) and ends[-1] else np.zeros(0, np.int64)
        return pa.table({"rep": ids, "neighbours": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))})

    ready = members
    if overlapping:
        lists = members.select("shard", "rep", "embedding").groupBy("shard").applyInArrow(build, "rep long, neighbours array<long>")
        united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))  # one list for each shard of a vector
        ready = members.join(united, "rep")

    def lists_of(group: pa.Table, ids: np.ndarray) -> list[np.ndarray]:
        """The united lists, those of members only."""
        order = np.argsort(ids)
        near = group.column("neighbours").combine_chunks()
        flat, ends = near.flatten().to_numpy(), near.offsets.to_numpy()
        ends = ends - ends[0]
        at = np.minimum(np.searchsorted(ids, flat, sorter=order), len(ids) - 1)
        local = np.where(ids[order[at]] == flat, order[at], -1)  # a neighbour from another shard may be no member here
        return [x[x >= 0] for x in np.split(local, ends[1:-1])]

    def search(key, group):
        v = unit(matrix(group.column("embedding")))
        ids, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        home = np.flatnonzero(group.column("home").to_numpy())
        # a shard whose vectors are in no other one has no lists to unite with its own
        local = lists_of(group, ids) if "neighbours" in group.column_names else build_graph(v)

        def by_product(queries: np.ndarray) -> list[np.ndarray]:
            out = []
            for low in range(0, len(queries), 256):
                close = v[queries[low : low + 256]] @ v.T >= threshold
                close[np.arange(len(close)), queries[low : low + 256]] = False
                out += [np.flatnonzero(x) for x in close]
            return out

        n_true = sum(len(x) for x in by_product(home[::audit_every]))
        extra, passes, first = 12, 0, None
        while True:
            found, met = range_search(v, local, home, threshold, threshold - 0.04, extra)
            n_found, passes = sum(len(x) for x in found[::audit_every]), passes + 1
            first = n_found if first is None else first
            if n_found >= wanted_recall * n_true:
                break
            if extra > len(ids):
                found, passes = by_product(home), -passes
                break
            extra *= 4
        total = np.array([copies[x].sum() + copies[h] - 1 for h, x in zip(home.tolist(), found, strict=True)], np.int64)
        forest = Forest(ids)
        for h, x in zip(home.tolist(), found, strict=True):
            for y in x.tolist():
                forest.join(h, y)
        return shard_result((ids[home], total), forest, key[0].as_py(), (len(ids), len(home), int(met.sum()), n_true, first, passes))

    out = ready.groupBy("shard").applyInArrow(search, OUT)

    def across(key, group):
        x, y = (k.as_py() for k in key[1:])
        block = group.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        v, block = unit(matrix(group.column("embedding")))[order], block[order]
        ids, copies, home = (group.column(c).to_numpy()[order] for c in ("rep", "copies", "home"))
        names, starts = np.unique(block, return_index=True)
        ends = [*starts[1:].tolist(), len(block)]
        low_precision, forest, total = v.astype(np.float32), Forest(ids), np.zeros(len(ids), np.int64)
        for p in range(len(names)):
            for q in range(p + 1, len(names)):
                if (names[p] // PANEL, names[q] // PANEL) != (x, y):
                    continue  # another task's
                others = slice(starts[q], ends[q])
                for low in range(starts[p], ends[p], 512):
                    rows = slice(low, min(low + 512, ends[p]))
                    # what comes near the threshold is measured in double
                    a, b = np.nonzero(low_precision[rows] @ low_precision[others].T >= threshold - 1e-5)
                    a, b = a + low, b + starts[q]
                    parts = 1 + (len(a) >> 14)
                    exact = np.concatenate([np.einsum("kd,kd->k", v[i], v[j]) for i, j in zip(np.array_split(a, parts), np.array_split(b, parts), strict=True)]) >= threshold
                    a, b = a[exact], b[exact]
                    np.add.at(total, a, copies[b])
                    np.add.at(total, b, copies[a])
                    counted = home[a] | home[b]
                    for i, j in zip(a[counted].tolist(), b[counted].tolist(), strict=True):
                        forest.join(i, j)
        linked = home & (total > 0)  # all have a row from their own block
        return shard_result((ids[linked], total[linked]), forest, key[0].as_py(), (max(np.diff([*starts, len(block)]).tolist()), int(home.sum()), 0, 0, 0, 0))

    if dealt is not None:
        panel = F.floor(F.col("block") / PANEL).cast("int")
        every = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("blocks") / PANEL).cast("int") - 1)))
        every = every.select("shard", F.least(panel, "other").alias("x"), F.greatest(panel, "other").alias("y"), "block", "rep", "embedding", "copies", "home")
        out = out.unionByName(every.groupBy("shard", "x", "y").applyInArrow(across, OUT))
    out = cut(out)
    audit = out.where("kind = 'audit'").select("shard", F.col("b").alias("members"), *AUDITED)
    whole = audit.agg(F.sum("links_true").alias("t"), F.sum("links_found").alias("f")).first()
    if whole["t"] and whole["f"] < least_recall * whole["t"]:
        raise RuntimeError(f"the graph alone found {whole['f']} of {whole['t']} audited links")
    components = connected_components(out.where("kind = 'edge'").select("a", "b"))
    links = out.where("kind = 'links'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n_links"))
    of_class = of_class.join(links, "rep").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select(F.col("label").alias("of_label"), "h1", "h2", "n_links", F.coalesce("component_id", "rep").alias("component_id"))
    joined = rows.withColumn("of_label", F.when(F.col("fit"), F.col("label"))).join(of_class, ["of_label", "h1", "h2"], "left")
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), audit
