"""Order statistics of groups of any size against sorted lists, and sketches that are merged."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spendloom.functions import order_stats as o
from spendloom.functions import stats
from spendloom.operators import anomalies
from tests.test_operators import contract, fairness_brute, frame


def groups(seed):
    """Group -> values: small, tied, hot, of very uneven spread; null keys and null values among them."""
    r = random.Random(seed)
    out = {"one": [3.0], "tie": [2.0] * 400, "hot": [round(r.lognormvariate(5, 3), 2) for _ in range(3000)], "far": [0.0] * 150 + [1e300] * 149 + [-1e300, 1e-300] * 20, "near": [1.0 + k * 2e-16 for k in range(300)]}
    out["gap"] = [r.uniform(0, 1) for _ in range(500)] + [1e9 + r.uniform(0, 1) for _ in range(500)]
    out[None] = [float(r.randrange(50)) for _ in range(300)]
    return out


def table(spark, by):
    rows = [(k, x) for k, xs in by.items() for x in xs] + [("none", None), ("tie", None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, x double")


@pytest.mark.parametrize("limit", [2, 40, 10_000])
def test_ranks_equal_sorted_lists(spark, limit):
    by = groups(1)
    got = o.order_statistics(table(spark, by), ["g"], "x", lambda n: [F.lit(0).cast("long"), F.lit(1).cast("long"), F.floor(n / 2), F.floor(n / 2) + 1, n, n + 1], limit).collect()
    assert {r.g for r in got} == set(by)
    for r in got:
        xs = sorted(by[r.g])
        at = lambda k: xs[k - 1] if 1 <= k <= len(xs) else None  # noqa: B023, E731
        assert r.n == len(xs) and r["at"] == [at(k) for k in (0, 1, len(xs) // 2, len(xs) // 2 + 1, len(xs), len(xs) + 1)], r.g


@pytest.mark.parametrize("limit", [7, 10_000])
def test_percentiles_of_whole_tables(spark, limit):
    xs = groups(2)["hot"]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = o.group_percentiles(df, [], "x", [0, 12.5, 50, 99, 100], limit).first()
    s = sorted(xs)

    def plain(p):
        k = (len(s) - 1) * p / 100
        return s[math.floor(k)] + (s[math.ceil(k)] - s[math.floor(k)]) * (k - math.floor(k))

    assert got.n == 3000 and got.percentiles == pytest.approx([plain(p) for p in (0, 12.5, 50, 99, 100)])
    assert o.group_percentiles(df.limit(0), [], "x", [50], limit).collect() == [] or o.group_percentiles(df.limit(0), [], "x", [50], limit).first().percentiles == [None]


def test_description_is_the_same_for_large_groups(spark):
    by = groups(3)
    del by["far"]
    df = table(spark, by)
    small, large = ({r.g: r for r in stats.describe(df, ["g"], "x", limit=n).collect()} for n in (10_000, 50))
    assert small.keys() == large.keys() == {*by, "none"}
    for k, r in small.items():
        assert tuple(map(str, r)) == pytest.approx(tuple(map(str, large[k]))), k
    want = df.where("g = 'hot'").agg(F.median("x"), F.percentile("x", 0.9)).first()
    assert (small["hot"].median, small["hot"].p90) == pytest.approx(tuple(want))
    assert small["none"].n == 0 and small["none"].median is None and small["none"].mad is None
    assert {r.g: r.mad for r in stats.with_mad(df, ["g"], "x", 50).collect()} == {k: small[k].mad for k in by}


@pytest.mark.parametrize("limit", [3, 1000])
def test_fairness_of_split_groups(spark, limit):
    r = random.Random(5)
    rows = [contract(k, r.choice([10, 20, 20, 30, 45.5, 70]), f"20{20 + r.randrange(2)}-{1 + r.randrange(12):02}-05", r.choice(["26", "26", "26", "31"]), r.choice(["7110", "7120", "35", ""])) for k in range(160)]
    got = {x.id: (x.peer_count, x.score) for x in anomalies.fairness_scores(frame(spark, rows), limit=limit).collect()}
    want = fairness_brute(rows)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_no_group_meets_in_a_window(spark):
    rows = frame(spark, [contract(k, 10 + k, category="26") for k in range(400)])
    plan = lambda limit: anomalies.fairness_scores(rows, limit=limit)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(1000) and "CartesianProduct" not in plan(50)
    # of a split group only an interval of few values is put in order
    assert all("first#" in line for line in plan(50).split("\n") if "Window [" in line)


def test_sketches_merge(spark):
    r = random.Random(6)
    rows = [(k % 3, k % 7, r.lognormvariate(3, 1)) for k in range(60_000)]
    df = spark.createDataFrame(rows, "g int, day int, x double")
    daily = o.quantile_sketches(df, ["g", "day"], "x")
    by = defaultdict(list)
    for g, _, x in rows:
        by[g].append(x)
    qs = [0.01, 0.25, 0.5, 0.9, 0.99]
    for row in o.merged_quantiles(daily, ["g"], qs).collect():
        s = sorted(by[row.g])
        assert row.n == len(s)
        for q, x in zip(qs, row.quantiles, strict=True):
            assert abs(sum(y <= x for y in s) / len(s) - q) <= o.SKETCH_ERROR
