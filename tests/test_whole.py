"""Queries and operators on the whole of their input, where a cut would be easy to miss."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spendloom.operators import retrieval
from spendloom.plans import queries as plans
from spendloom.plans.presets import contracts
from tests.test_operators import fairness_brute
from tests.test_queries import SF


def test_fairness_scores_every_contract(spark):
    by_category = defaultdict(list)
    for r in contracts(spark, SF).where("amount > 0").collect():
        by_category[r.category].append((r.id, r.customer, r.supplier, r.category, r.region, r.amount, r.sign_date))
    wanted = {}
    for rows in by_category.values():
        wanted |= {k: v for k, v in fairness_brute(rows).items() if v[1] < 0.7 or v[1] > 1.3}
    got = {r.entity_id: (r.peer_count, r.score) for r in plans.QUERIES["a3_fairness_anomalies_whole"](spark, SF).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[k][0] == wanted[k][0] and got[k][1] == pytest.approx(wanted[k][1]) for k in wanted)


def test_volumes_of_all_categories(spark):
    rows = contracts(spark, SF).select("id", F.substring("category", 1, 1).alias("first"))
    found = plans.QUERIES["a2_volume_anomalies_whole"](spark, SF).join(rows, "id")
    assert {r.first for r in found.select("first").distinct().collect()} == {r.first for r in rows.select("first").distinct().collect()}


def test_bundle_has_all_sections(spark):
    got = {r.section for r in plans.QUERIES["q8_analytics_bundle_whole"](spark, SF).collect()}
    assert got == {"customer", "category", "region", "concentration", "year", "total"}


def test_bundle_counts_all_contracts(spark):
    got = plans.QUERIES["q8_analytics_bundle_whole"](spark, SF).where("section IN ('region', 'year')").groupBy("section").agg(F.sum("contract_count").alias("n"), F.sum("value").alias("v")).collect()
    wanted = contracts(spark, SF).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("v")).first()
    assert {(r.section, r.n, round(r.v, 2)) for r in got} == {(s, wanted.n, wanted.v) for s in ("region", "year")}


def test_top_k_over_more_queries_than_a_block(spark):
    r = random.Random(4)
    rows = [(k, [float(r.randrange(-3, 4)) for _ in range(3)]) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in retrieval.cosine_top_k(df.select(F.col("vec_id").alias("query_id"), "embedding"), df, max_queries=50, slice_rows=40).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    norm = {k: dot(v, v) ** 0.5 for k, v in rows}
    wanted = {k: sorted(((-dot(v, w) / (norm[k] * norm[j]), j) for j, w in rows if norm[j] > 0))[:20] for k, v in rows if norm[k] > 0}
    assert got == {k: [(j, -s) for s, j in best] for k, best in wanted.items()}


def test_context_takes_a_short_candidate_far_down(spark):
    sizes = [7] * 1200 + [3] + [7] * 5 + [1]
    df = spark.createDataFrame([(1, k, "w " * n) for k, n in enumerate(sizes)], "question_id long, entity_id long, content string")
    got = [(r.entity_id, r.place, r.token_count) for r in retrieval.context_window(df, 4, 11, 60, order=["entity_id"]).orderBy("place").collect()]
    assert got == [(0, 1, 7), (1200, 1201, 3), (1206, 1207, 1)]
