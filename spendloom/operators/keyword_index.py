"""An inverted index of documents for keyword scores: postings in blocks with their maxima, and top-k that skips blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.functions import text as tx
from spendloom.sources.shared import kept

#: Scores are summed in another order than bounds; this much is added to these.
SLACK = 1e-9


@dataclass
class KeywordIndex:
    """docs: (block, pos, key); postings: (block, token, pos, part, top), the places of the documents of a block that hold
    a token, what each adds to a score before the token's weight, and the largest of that; terms: (token, df)."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n_docs: int
    key: tuple[str, ...]


def keyword_index(documents: DataFrame, boosts: Mapping[str, float], other: float = 0.8, k1: float = 1.5, b: float = 0.75, key: Sequence[str] = ("entity_type", "entity_id"), content: str = "content", block_docs: int = 1024) -> KeywordIndex:
    """Builds the index; each of its tables is kept in the shared checkpoint folder.

    Documents are dealt into blocks of about ``block_docs`` by a hash, so a token that every document holds has as many
    postings rows as there are blocks, none of them long. One shuffle deals the documents; all that follows is counted
    within blocks. ``boosts`` weigh the first key column, ``other`` what they don't name.
    """
    docs = kept(documents.select(*key, tx.tokens(F.coalesce(F.col(content), F.lit(""))).alias("tokens")).withColumn("len", F.greatest(F.size("tokens"), F.lit(1))))
    n_docs, mean = docs.agg(F.count(F.lit(1)), F.avg("len")).first()
    blocks = max(1, -(-n_docs // block_docs))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"))
    # places follow the key, so that the first of equal scores is the one that the key puts first
    dealt = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy(*key)) - 1)
    boost = F.coalesce(*(F.when(F.col(key[0]) == k, F.lit(float(v))) for k, v in boosts.items()), F.lit(float(other)))
    tf = dealt.select("block", "pos", "len", boost.alias("boost"), F.explode("tokens").alias("token")).groupBy("block", "token", "pos", "len", "boost").agg(F.count(F.lit(1)).alias("tf"))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / max(mean or 1.0, 1.0)))
    each = tf.withColumn("part", F.log1p("tf") * norm * F.col("boost"))
    lists = each.groupBy("block", "token").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p"), F.max("part").alias("top"))
    postings = kept(lists.select("block", "token", F.col("p.pos").alias("pos"), F.col("p.part").alias("part"), "top"))
    terms = kept(postings.groupBy("token").agg(F.sum(F.size("pos")).alias("df")))
    return KeywordIndex(kept(dealt.select("block", "pos", *key)), postings, terms, n_docs, tuple(key))


def _best_of_block(top: int, digits: int | None):
    """The ``top`` best documents of a block for each question that comes to it."""

    def score(key: tuple, asked: pa.Table, postings: pa.Table) -> pa.Table:
        words = {w: k for k, w in enumerate(postings["token"].to_pylist())}
        lists, parts = postings["pos"].combine_chunks(), postings["part"].combine_chunks()
        bounds = lists.offsets.to_numpy()
        pos, part = lists.values.to_numpy(), parts.values.to_numpy()
        width = int(pos.max(initial=-1)) + 1
        row = np.array([words.get(w, -1) for w in asked["token"].to_pylist()], np.int64)
        who, at = np.unique(asked["question_no"].to_numpy(), return_inverse=True)
        # tokens in one order, so that equal documents get equal sums
        order = np.lexsort((np.array(asked["token"].to_pylist(), object).astype(str), at)) if len(row) else np.zeros(0, np.int64)
        weight = asked["weight"].to_numpy()
        total = np.zeros((len(who), width))
        for k in order.tolist():
            if row[k] >= 0:
                own = slice(bounds[row[k]], bounds[row[k] + 1])
                total[at[k], pos[own]] += weight[k] * part[own]
        shown = total if digits is None else np.round(total, digits)
        q, p, s = [], [], []
        for k in range(len(who)):
            held = np.flatnonzero(total[k] > 0)
            best = held[np.argsort(-shown[k, held], kind="stable")[:top]]
            q.append(np.full(len(best), who[k])), p.append(best), s.append(shown[k, best])
        cat = lambda xs, kind: pa.array(np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind))
        n = sum(map(len, p))
        return pa.table({"question_no": cat(q, np.int64), "block": pa.array(np.full(n, key[0].as_py(), np.int32)), "pos": cat(p, np.int32), "score": cat(s, np.float64)})

    return score


def _still_open(bound: DataFrame, found: DataFrame, top: int, slack: float) -> DataFrame:
    """Pairs of a question and a block whose bound reaches the ``top``-th best score found, if there are so many."""
    nth = Window.partitionBy("question_no").orderBy(F.desc("score"))
    least = found.withColumn("n", F.row_number().over(nth)).where(F.col("n") == top).select("question_no", F.col("score").alias("least"))
    return bound.join(least, "question_no", "left").where(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least")))


def bm25_top(questions: DataFrame, index: KeywordIndex, top: int, digits: int | None = None, question_id: str = "question_id", question: str = "text", first: int = 2) -> DataFrame:
    """(question_id, key, bm25, place) of the ``top`` best documents of each question; ties go by the key.

    The scores are those of ``retrieval.bm25``, rounded to ``digits`` places first if given. A question and a block
    have a bound: the weights of the question's tokens times their maxima in the block. The ``first`` blocks of highest
    bound are scored; then only those whose bound reaches the last of the best found there. A task scores one block for
    the questions that come to it and hands on ``top`` rows a question, so no row is made for a pair of a question and a
    document that only share a word.
    """
    asked = questions.select(F.col(question_id).alias("question_id"), F.explode(tx.tokens(F.col(question))).alias("token"))
    asked = asked.groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("times"))
    idf = F.log1p((F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(index.terms, "token").select("question_id", F.xxhash64("question_id").alias("question_no"), "token", (F.col("times") * idf).alias("weight"))
    asked = kept(asked)
    bound = asked.join(index.postings.select("token", "block", "top"), "token").groupBy("question_no", "block").agg((F.sum(F.col("weight") * F.col("top")) * (1 + SLACK)).alias("bound"))
    order = Window.partitionBy("question_no").orderBy(F.desc("bound"), "block")
    bound = kept(bound.withColumn("nth", F.row_number().over(order)))

    def scored(pairs: DataFrame) -> DataFrame:
        left = pairs.select("question_no", F.col("block").alias("b")).join(asked.select("question_no", "token", "weight"), "question_no")
        right = index.postings.select("block", "token", "pos", "part")
        return left.groupBy("b").cogroup(right.groupBy("block")).applyInArrow(_best_of_block(top, digits), "question_no long, block int, pos int, score double")

    one = kept(scored(bound.where(F.col("nth") <= first)))
    found = one.unionByName(scored(_still_open(bound.where(F.col("nth") > first), one, top, 0.0 if digits is None else 10.0**-digits))).join(index.docs, ["block", "pos"])
    place = F.row_number().over(Window.partitionBy("question_no").orderBy(F.desc("score"), *index.key))
    best = found.withColumn("place", place).where(F.col("place") <= top)
    return best.join(asked.select("question_no", "question_id").distinct(), "question_no").select("question_id", *index.key, F.col("score").alias("bm25"), "place")
