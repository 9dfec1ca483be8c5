"""Filtered top-k from lists against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.operators import retrieval
from spendloom.operators import vector_lists as vl

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed, n, dim=8, centers=12, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centers, dim))
    return [(i, (c[i % centers] + spread * r.normal(size=dim)).astype(np.float32).tolist(), int(r.integers(4))) for i in range(n)]


def brute(rows, asked, k, keep=lambda label: True):
    out = {}
    for q, v, *_ in asked:
        scores = sorted((-retrieval_score(v, w), i) for i, w, label in rows if keep(label) and w is not None and any(w) and len(w) == len(v))
        out[q] = [(i, round(-s, 9)) for s, i in scores[:k]]
    return out


def retrieval_score(a, b):
    dot = lambda x, y: sum(float(p) * float(q) for p, q in zip(x, y, strict=True))
    return round(dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 12)


@pytest.mark.parametrize("list_rows,first", [(20, 1), (60, 3), (100_000, 4)])
def test_equals_brute_force(spark, list_rows, first):
    rows = clustered(1, 400) + [(900, [1.0, 2.0], 1), (901, [2.0, 1.0], 1), (902, [0.0] * 8, 1), (903, None, 1)] + [(910 + k, [0.5] * 8, k % 4) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [r for r in rows if r[1] is not None and any(r[1]) and r[0] % 9 == 0] + [(900, [1.0, 2.0], 1)]
    q = spark.createDataFrame([(i, v) for i, v, _ in dict((r[0], r) for r in asked).values()], "query_id long, embedding array<float>")
    index = vl.vector_lists(df, ["label"], list_rows=list_rows, sample=200)
    for condition, keep in ((None, lambda label: True), (F.col("label") == 2, lambda label: label == 2)):
        got = {}
        for r in vl.nearest_in_lists(q, index, 6, condition, first=first, slice_rows=50, max_queries=10).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        want = {i: x for i, x in brute(rows, asked, 6, keep).items() if x}
        assert got.keys() == want.keys()
        for i, x in want.items():
            assert [s for _, s in got[i]] == pytest.approx([s for _, s in x]), i
            assert [j for j, _ in got[i]] == [j for j, _ in x], i


def test_far_lists_are_not_met(spark):
    rows = clustered(2, 1200, spread=0.01)
    df = spark.createDataFrame(rows, SCHEMA)
    index = vl.vector_lists(df, list_rows=100, sample=1200)
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vl.nearest_in_lists(q, index, 5, first=2).collect()
    assert len(got) == 24 * 5 and all(r.vec_id % 12 == r.query_id % 12 for r in got)
    asked = q.select("query_id", "embedding", F.lit(8).alias("width"), F.lit(1.0).alias("norm"), F.lit(0.99).alias("least"))
    known = index.centers, index.radius
    rest = asked.mapInArrow(lambda b: vl._visits(b, known, 2, True), "query_id long, embedding array<float>, width int, norm double, lists array<int>")
    assert rest.agg(F.max(F.size("lists"))).first()[0] <= 2 < len(index.centers[8])


def test_empty(spark):
    df = spark.createDataFrame(clustered(3, 20), SCHEMA)
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    assert vl.nearest_in_lists(q, vl.vector_lists(df.limit(0)), 5).count() == 0
    assert vl.nearest_in_lists(q.limit(0), vl.vector_lists(df), 5).count() == 0
    assert vl.nearest_in_lists(q, vl.vector_lists(df, ["label"]), 5, F.col("label") == 77).count() == 0
