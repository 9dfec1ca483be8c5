"""Top keyword scores from the index against scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from spendloom.operators import keyword_index as ki
from spendloom.operators import retrieval


def data(spark, seed, n_docs=90, n_questions=25):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["the"] * 30 + ["Цена", "a-b"]
    docs = [(r.choice(["contract", "lot", "plan", "memo"]), k, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for k in range(n_docs)]
    docs += [("lot", 500 + k, docs[3][2]) for k in range(12)] + [("plan", 600, None), ("plan", 601, "the " * 300)]
    asked = [(k, " ".join(r.choice([*words, "nowhere"]) for _ in range(r.randrange(0, 6)))) for k in range(n_questions)] + [(900, docs[3][2]), (901, "the the цена"), (902, None)]
    return spark.createDataFrame(asked, "question_id long, text string"), spark.createDataFrame(docs, "entity_type string, entity_id long, content string")


@pytest.mark.parametrize("block_docs,first", [(1024, 2), (7, 1), (3, 2)])
def test_equals_scores_of_all_pairs(spark, block_docs, first):
    questions, docs = data(spark, block_docs)
    want = retrieval.best_per_question(retrieval.bm25(questions, docs).withColumn("bm25", F.round("bm25", 6)), 5)
    got = ki.bm25_top(questions, ki.keyword_index(docs, retrieval.BOOSTS, block_docs=block_docs), 5, 6, first=first)
    rows = lambda df: sorted((r.question_id, r.place, r.entity_type, r.entity_id, round(r.bm25, 6)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) > 80


def test_blocks_below_the_bound_are_not_scored(spark, monkeypatch):
    questions = spark.createDataFrame([(1, "rare common")], "question_id long, text string")
    docs = spark.createDataFrame([("lot", k, "common word" + " rare rare rare" * (k < 40)) for k in range(4000)], "entity_type string, entity_id long, content string")
    index = ki.keyword_index(docs, {}, block_docs=50)
    seen = []
    inner = ki._still_open
    monkeypatch.setattr(ki, "_still_open", lambda *a: seen.append(inner(*a).count()) or inner(*a))
    got = ki.bm25_top(questions, index, 3)
    assert [r.entity_id for r in got.orderBy("place").collect()] == [0, 1, 2]
    # of 80 blocks only those with the rare word can reach the third best
    assert seen[0] + 2 == index.postings.where("token = 'rare'").count() < 40


def test_empty_sides(spark):
    questions, docs = data(spark, 1)
    index = ki.keyword_index(docs.limit(0), retrieval.BOOSTS)
    assert ki.bm25_top(questions, index, 5).count() == 0
    assert ki.bm25_top(questions.limit(0), ki.keyword_index(docs, retrieval.BOOSTS), 5).count() == 0
