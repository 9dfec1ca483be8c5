import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.llm import embedding_dedup
from spendloom.llm.embedding_dedup import near_duplicate_vectors
from spendloom.llm.nearest import nearest_vectors, probe_sets

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [float("nan")] + [1.0] * 7, 1), (9004, [float("inf")] * 8, 1), (9005, [None] + [1.0] * 7, 1), (9006, [1.0, 2.0], 1), (None, [1.0] * 8, 1)]


def vectors(n=900, dim=8, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k % 3 and rows:
            base = np.array(rows[int(r.integers(len(rows)))][1])
            v = base if k % 5 == 0 else base + r.normal(0, 0.05, dim) * np.linalg.norm(base)
        else:
            v = r.normal(0, 1, dim)
        rows.append((k, [float(np.float32(x)) for x in v], None if k % 50 == 7 else int(r.integers(3))))
    return rows


def brute(rows, threshold=0.98):
    ok = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, va, la in ok:
        for b, vb, lb in ok:
            if a < b and la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= threshold:
                links[a].add(b)
                links[b].add(a)
    component = {}
    for i in sorted(x for x in links if x is not None):
        if i not in component:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in component:
                    component[x] = i
                    stack += links[x]
    return links, component


@pytest.mark.parametrize("shard_size", [6000, 60])
def test_near_duplicate_vectors_equal_brute_force(spark, shard_size):
    rows = vectors() + ODD
    result, audit = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(0)), shard_size=shard_size)
    links, component = brute(rows)
    got = {r.vec_id: r for r in result.collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r.component_id for i, r in got.items() if i is not None} == component
    assert all(r.kept == (i is not None and i == r.component_id) for i, r in got.items())
    seen = audit.agg(F.sum("links_true"), F.sum("links_found"), F.count(F.lit(1))).first()
    assert seen[1] >= 0.98 * seen[0] and (shard_size > 1000 or seen[2] > 4)


def test_audit_fails_on_what_the_graph_alone_finds(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    audit = near_duplicate_vectors(df)[1]
    assert all(r.passes == 1 or r.links_found < r.links_true for r in audit.collect())
    with pytest.raises(RuntimeError, match="the graph alone"):
        near_duplicate_vectors(df, least_recall=1.5)


def test_hot_copies_and_empty(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0, 0.5], 1) for k in range(500)] + [(k, [0.0, 1.0, 0.0], 1) for k in range(500, 503)] + [(700, [1.0, 0.01, 0.5], 1), (700, [1.0, 0.01, 0.5], 1)], SCHEMA)
    got = near_duplicate_vectors(df)[0].collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 501), (500, 2)}
    assert near_duplicate_vectors(df.limit(0))[0].count() == 0


def test_probe_sets_are_valid_and_ordered():
    sets = probe_sets(4, 30)
    assert sets[0] == [] and sets[1] == [0] and len({tuple(s) for s in sets}) == len(sets)
    assert all(7 - k not in s for s in sets for k in s)


def test_nearest_vectors_recall_and_scores(spark):
    rows = [(i, v, 0) for i, v, _ in vectors(3000, 16, 1)] + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = nearest_vectors(df, F.col("vec_id") % 20 == 0).collect()
    good = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and i < 9000}
    ids = np.array(sorted(good))
    matrix = np.array([good[i] for i in ids])
    right = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in good if i % 20 == 0}
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        s = matrix @ good[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert [r.rank for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert all(abs(r.score - good[q] @ good[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        right += len({r.vec_id for r in own} & set(best.tolist()))
        total += 20
    assert right >= 0.9 * total


def test_nearest_few_candidates_ties_and_empty(spark):
    df = spark.createDataFrame([(k, [1.0, 1.0], 0) for k in range(30)] + [(100, [-5.0, 0.0], 0), (40, [1.0, 2.0, 3.0], 0), (60, [3.0, 2.0, 1.0], 0)], SCHEMA)
    got = nearest_vectors(df, F.col("vec_id") % 20 == 0).collect()
    of = lambda q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
    assert of(0) == list(range(1, 21)) and of(20) == list(range(20)) and of(100) == list(range(20))
    assert of(40) == [60] and of(60) == [40]
    assert nearest_vectors(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_that_no_cell_parts_are_dealt_into_blocks(spark):
    r = np.random.default_rng(6)
    base = r.normal(0, 1, 8)
    rows = [(k, [float(np.float32(x)) for x in base + r.normal(0, 0.06, 8)], 1) for k in range(260)]
    result, audit = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), shard_size=40)
    links, component = brute(rows)
    got = {x.vec_id: x for x in result.collect()}
    assert {i: x.n_links for i, x in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: x.component_id for i, x in got.items()} == component
    assert audit.where("members > 90").count() == 0


def test_nearest_blocks_of_rows_and_queries_and_many_lengths(spark):
    r = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in r.normal(0, 1, 3 + k % 4)], 0) for k in range(800)]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    got = {}
    for x in nearest_vectors(df, F.col("vec_id") % 2 == 0, k=5, block_rows=40, block_queries=16, probes=20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    right = 0
    for q, v, _ in rows[::2]:
        s = sorted((-float(np.dot(np.array(v), np.array(u))), i) for i, u, _ in rows if len(u) == len(v) and i != q)[:5]
        right += len({i for _, i in s} & {i for _, i in got[q]})
    assert len(got) == 400 and right >= 0.9 * 2000


def test_shards_without_structure_are_not_copied_to_most_cells(spark, monkeypatch):
    r = np.random.default_rng(8)
    made = r.normal(0, 1, (900, 32))
    made[1::9] = made[::9] + r.normal(0, 0.02, (100, 32))
    rows = [(k, [float(np.float32(x)) for x in v], 1) for k, v in enumerate(made)]
    sizes, inner = [], embedding_dedup.cut
    monkeypatch.setattr(embedding_dedup, "cut", lambda df: sizes.append((out := inner(df)).count()) or out)
    got = {x.vec_id: x for x in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), shard_size=20)[0].collect()}
    links, component = brute(rows)
    assert {i: x.n_links for i, x in got.items()} == {i: len(x) for i, x in links.items()} and sum(map(len, links.values())) >= 150
    assert {i: x.component_id for i, x in got.items()} == component
    assert max(sizes) <= embedding_dedup.MOST_COPIES * len(rows)
