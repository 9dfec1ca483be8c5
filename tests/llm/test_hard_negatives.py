"""Hard negatives against brute force: clustered, unstructured, tied and awkward vectors, in small cells and blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from spendloom.llm.hard_negatives import CoverTree, Windows, augmented, bounds, descend, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, score int, `a.b` string, v string"


def plain(rows, every):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(own, kept.get(i, own))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in kept.items() if i != a and len(w) == len(v))
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:3]
            out += [(a, p, r + 1, i, -minus, -s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out)


def got(spark, rows, every, **sizes):
    df = spark.createDataFrame([(*r, "d", 1, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, **sizes).collect()))


def clustered(seed, n, dim=6):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, dim))
    return [(i, (centers[i % 5] + 0.3 * r.normal(size=dim)).astype(np.float32).tolist(), int(r.integers(3))) for i in range(n)]


SMALL = {"block_rows": 40, "block_queries": 7, "cells": 6, "sample": 50, "first": 1}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_equals_brute_force(spark, sizes):
    rows = clustered(1, 400)
    assert got(spark, rows, 8, **sizes) == plain(rows, 8)


def test_ties_and_awkward_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], r.randrange(3)) for i in range(150)]
    rows += [(i, [0.5, 0.5, 1.0], i % 2) for i in range(150, 300)]  # one vector very often
    rows += [(300, [1.0, 2.0], 0), (301, [1.0, 1.5], 0), (302, [1.0, 0.9], 1), (304, [1.0, 2.0], 1), (306, [0.4, 1.1], 2)]  # of another length
    rows += [(308, None, 1), (310, [1.0, None, 1.0], 1), (312, [1.0, float("nan"), 1.0], 1), (314, [float("inf"), 0.0, 0.0], 1), (316, [0.0, 0.0, 0.0], 1), (318, [1.0, 0.0, 1.0], None)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (4, rows[4][1], rows[4][2]), (8, [9.0, 9.0, 9.0], 2), (320, [], 1), (322, [], 2), (324, [], 1)]
    want = plain(rows, 4)
    assert len(want) > 100 and any(w[4] == 0 for w in want)
    assert got(spark, rows, 4, **SMALL) == want
    assert got(spark, rows, 4) == want


def test_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") % 2 == 0).collect() == []
    assert got(spark, [(0, [1.0, 2.0], 1)], 2) == [] and got(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], 2) == []
    assert got(spark, clustered(2, 50), 1000) == plain(clustered(2, 50), 1000)


def test_large_components_stay_exact_or_fail(spark):
    rows = [(i, [40_000.0 + i % 7, 30_000.0 - i, 1.5 * i], i % 3) for i in range(60)]
    assert got(spark, rows, 5) == plain(rows, 5)  # products between 2^53 and 2^56
    with pytest.raises(PythonException, match="scale the vectors down"):
        got(spark, [(i, [4e6, 1e6 * i, 0.0], i % 2) for i in range(9)], 2)


def test_balls_bound_products():
    r = np.random.default_rng(5)
    for spread in (0.01, 1.0):
        x = np.floor(256 * (r.normal(size=(3, 8))[r.integers(0, 3, 500)] + spread * r.normal(size=(500, 8))))
        q = np.floor(256 * r.normal(size=(20, 8)))
        top = float((x**2).sum(axis=1).max())
        tree = CoverTree(augmented(x, top), leaf=10, fanout=4)
        lower, upper, _ = bounds(q, tree.spheres, tree.radius, top)
        exact = x[tree.order] @ q.T
        assert sorted(tree.order.tolist()) == list(range(500))
        for node, (low, high) in enumerate(tree.span):
            assert (exact[low:high] <= upper[node]).all() and (exact[low:high] >= lower[node]).all()
            below = [tree.span[c] for c in tree.children[node]]
            assert not below or (sum(b - a for a, b in below) == high - low and min(a for a, _ in below) == low)
            assert all(tree.radius[c] <= 2 * tree.radius[node] for c in tree.children[node])


def test_nodes_outside_are_skipped():
    r = np.random.default_rng(6)
    x = np.floor(256 * (r.normal(size=(40, 8))[r.integers(0, 40, 4000)] + 0.02 * r.normal(size=(4000, 8))))
    top = float((x**2).sum(axis=1).max())
    tree = CoverTree(augmented(x, top))
    q = x[:5]
    wants = [[{"low": int(a * s), "high": int(b * s), "least": None} for a, b in ((0.5, 0.95), (0.2, 0.4))[: 1 + k % 2]] for k, s in enumerate((q * q).sum(axis=1))]
    windows = Windows(wants, 3)
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    done = descend(tree, bounds(q, tree.spheres, tree.radius, top), (x[tree.order], ids[tree.order], labels), (q, np.arange(5), labels[:5] + 1), windows, False)
    for i, row in enumerate(wants):
        for j, w in enumerate(row):
            exact = sorted((-s, k) for k, s in enumerate(x @ q[i]) if k != i and w["low"] <= s <= w["high"])[:3]
            own = windows.slot == i * 2 + j
            assert [(-s, k) for s, k in zip(windows.score[own], windows.vec_id[own], strict=True)] == exact
    assert done < 0.5 * x.shape[0] * len(q)
