"""Top keyword scores of many questions, shard by shard, against scores of all pairs."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.operators import keyword_batch as kb
from spendloom.operators import keyword_index as ki
from spendloom.operators import retrieval
from spendloom.plans import text_queries
from tests.test_keyword_index import data


@pytest.mark.parametrize("shard_tokens,head_part,head_shards", [(6_000_000, 16, 8), (60, 8, 3), (300, 2, 1), (40, 1000, 2)])
def test_equals_scores_of_all_pairs(spark, shard_tokens, head_part, head_shards):
    questions, docs = data(spark, shard_tokens)
    want = retrieval.best_per_question(retrieval.bm25(questions, docs).withColumn("bm25", F.round("bm25", 6)), 5)
    got = kb.bm25_best(questions, docs, 5, retrieval.BOOSTS, 6, shard_tokens=shard_tokens, head_part=head_part, head_shards=head_shards)
    rows = lambda df: sorted((r.question_id, r.place, r.entity_type, r.entity_id, round(r.bm25, 6)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) > 80


def test_empty_sides(spark):
    questions, docs = data(spark, 1)
    assert kb.bm25_best(questions, docs.limit(0), 5, {}).count() == 0
    assert kb.bm25_best(questions.limit(0), docs, 5, {}).count() == 0


def test_groups_cover_all_classes_longest_first():
    r = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in enumerate(r.integers(1, 900, 40))}
    sizes = {k: int(n * 2 ** (k / 4)) + 1 for k, n in counts.items()}
    groups = kb._dealt(sizes, counts, 20, 20_000, 16, 8)
    lows = [low for low, _ in groups]
    assert lows == sorted(lows, reverse=True) and lows[-1] == 0
    for (low, n), high in zip(groups, [99, *lows], strict=False):
        assert sum(t for k, t in sizes.items() if low <= k < high) <= n * 20_000


def test_what_the_query_writes_follows_texts_and_questions(spark, monkeypatch):
    """The index's texts, postings and bounds of pairs took many times the texts."""
    sf, context = "/root/testdata/sf0.01", spark.sparkContext
    written = []
    for module in (kb, ki):
        inner = module.kept

        def kept(df, inner=inner):
            before, folder = context._jsc.sc().getCheckpointDir(), tempfile.mkdtemp(prefix="spark-")
            context.setCheckpointDir(folder)
            out = inner(df)
            written.append(sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names))
            if before.isDefined():
                context._jsc.sc().setCheckpointDir(before.get())
            return out

        monkeypatch.setattr(module, "kept", kept)
    assert text_queries.r5_bm25(spark, sf).count() > 1000
    texts = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < sum(written) < texts / 2
