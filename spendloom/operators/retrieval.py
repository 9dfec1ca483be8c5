"""Documents, keyword and vector retrieval over many questions at once."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.functions import text as tx
from spendloom.functions.normalize import hash_id

BOOSTS = {"contract": 1.0, "lot": 0.95, "announcement": 0.9, "plan": 0.85}
TYPE_LIMITS = {"SEARCH": 10, "COMPARISON": 50, "ANALYTICS": 30, "ANOMALY": 100, "FAIRNESS": 50}
DOCUMENT_COLUMNS = ["entity_type", "entity_id", "content", "customer", "category", "sign_date", "amount", "supplier"]


def entity_documents(rows: DataFrame, entity_type: str, content: Column, **columns: str) -> DataFrame:
    """Latest rows as documents of the common columns; ``columns`` names those that differ, missing ones are null."""
    kinds = {"entity_id": "long", "customer": "long", "category": "string", "sign_date": "timestamp_ntz", "amount": "double", "supplier": "long"}
    own = {c: F.col(columns.get(c, c)).cast(k) if columns.get(c, c) in rows.columns else F.lit(None).cast(k) for c, k in kinds.items()}
    return rows.select(F.lit(entity_type).alias("entity_type"), content.alias("content"), *(v.alias(k) for k, v in own.items())).select(*DOCUMENT_COLUMNS)


# Texts of the entities, a short and a long one; names in braces are columns.
SHORT_TEXTS = {
    "contract": "Contract {number} ENSTR {category} KATO {region} amount {amount}",
    "lot": "Lot {number} ENSTR {category} KATO {region} amount {amount}",
    "announcement": "Announcement {number} total_sum {amount} lots {count_lots}",
    "plan": "Plan {number} ENSTR {category} KATO {region} amount {amount}",
}
LONG_TEXTS = {
    "contract": "Contract #{number}. Contract ID {id}. Customer BIN {customer}. Supplier BIN {supplier}. ENSTR code {category}. KATO {region}. Trade buy ID {announcement_id}. Lot ID {lot_id}. Signed on {sign_date}. Contract sum {amount:.2f}.",
    "lot": "Lot #{number}. Lot ID {id}. Announcement {announcement_id}. Customer BIN {customer}. Supplier BIN {supplier}. ENSTR code {category}. KATO {region}. Quantity {quantity:.3f}. Amount {amount:.2f}. Created at {sign_date}.",
    "announcement": "Announcement #{number}. Announcement ID {id}. Customer BIN {customer}. Total sum {amount:.2f}. Lots {count_lots}. Trade method {trade_method_id}. Status {status_id}. Publish date {sign_date}. Start date {start_date}. End date {end_date}.",
    "plan": "Plan #{number}. Plan ID {id}. Customer BIN {customer}. ENSTR code {category}. KATO {region}. Planned amount {amount:.2f}. Quantity {quantity:.3f}. Plan year {plan_year}. Publish date {sign_date}.",
}


def entity_text(rows: DataFrame, entity_type: str, long: bool = False) -> Column:
    """Text of the latest rows of an entity; columns that ``rows`` does not have, and nulls, are left blank."""
    parts = []
    for k, piece in enumerate(re.split(r"\{([^}]*)\}", (LONG_TEXTS if long else SHORT_TEXTS)[entity_type])):
        name, _, form = piece.partition(":")
        if k % 2 == 0:
            parts.append(F.lit(piece))
        elif name not in rows.columns:
            parts.append(F.lit(""))
        else:
            shown = F.format_string(f"%{form}", F.col(name).cast("double")) if form else F.col(name).cast("string")
            parts.append(F.coalesce(F.when(F.col(name).isNotNull(), shown), F.lit("")))
    return F.concat(*parts)


def union_documents(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def best_per_question(scores: DataFrame, top: int, score: str = "bm25", key: Sequence[str] = ("entity_type", "entity_id"), question_id: str = "question_id") -> DataFrame:
    """The ``top`` rows of highest score of each question, ties by ``key``, with ``place``."""
    order = Window.partitionBy(question_id).orderBy(F.desc(score), *key)
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def recent(documents: DataFrame, n: int = 200, order: str = "sign_date") -> DataFrame:
    """The ``n`` most recent documents, ties by type and id."""
    return documents.orderBy(F.desc(order), "entity_type", "entity_id").limit(n)


def bm25(questions: DataFrame, documents: DataFrame, k1: float = 1.5, b: float = 0.75, boosts: Mapping[str, float] = BOOSTS, question_id: str = "question_id", question: str = "text", key: Sequence[str] = ("entity_type", "entity_id"), content: str = "content") -> DataFrame:
    """(question_id, key, bm25) of documents that share a token with a question.

    N, document frequencies and the mean length are those of ``documents``; a repeated word of a question counts again.
    Questions and documents meet by token, never all with all.
    """
    docs = documents.select(*key, tx.tokens(F.col(content)).alias("tokens")).withColumn("len", F.greatest(F.size("tokens"), F.lit(1)))
    whole = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("mean_len"))
    tf = docs.select(*key, "len", F.explode("tokens").alias("token")).groupBy(*key, "token", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    asked = questions.select(F.col(question_id).alias("question_id"), F.explode(tx.tokens(F.col(question))).alias("token")).groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("times"))
    weighed = asked.join(df, "token").crossJoin(F.broadcast(whole))  # one row
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("mean_len", F.lit(1.0))))
    hits = tf.join(weighed, "token").withColumn("part", F.col("times") * F.log1p(F.col("tf")) * idf * norm)
    boost = F.coalesce(F.create_map(*(x for k, v in boosts.items() for x in (F.lit(k), F.lit(v))))[F.col("entity_type")], F.lit(0.8)) if "entity_type" in key else F.lit(1.0)
    return hits.groupBy("question_id", *key).agg(F.sum("part").alias("score")).select("question_id", *key, (F.col("score") * boost).alias("bm25"))


def chunk_rows(documents: DataFrame, max_chars: int = 800, overlap: int = 100, content: str = "content", keep: Sequence[str] = ("entity_type", "entity_id")) -> DataFrame:
    """One row per chunk: the kept columns, chunk_no, chunk, and chunk_id, a hash of the kept columns and the number
    that other systems can compute too."""
    rows = documents.select(*keep, F.posexplode(tx.chunks(F.col(content), max_chars, overlap)).alias("chunk_no", "chunk"))
    return rows.withColumn("chunk_id", hash_id(*(F.col(k) for k in keep), F.col("chunk_no")))


def vector_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vector (chunk_id, embedding) and its norm."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return chunks.join(vectors, "chunk_id").withColumn("norm", norm)


def upsert_index(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """An index after an upsert: rows of ``new`` replace those of the same key, others stay; one shuffle on the key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def payload_filter(customers: Sequence[int] = (), category: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """Any of the customers, category containing a text, inclusive days."""
    out = F.col("customer").isin(list(customers)) if customers else F.lit(True)
    if category:
        out = out & F.contains(F.col("category"), F.lit(category))
    if start:
        out = out & (F.col("sign_date") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out & (F.col("sign_date") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return out


def _best_of_slice(k: int, asked: pa.Table, stored: pa.Table, rows: int = 256) -> pa.Table:
    """The ``k`` best stored vectors of each query, ties to the smaller id. A matrix product finds the candidates; their
    scores are then summed in the order of the components, so equal vectors have equal scores."""
    if not (len(asked) and len(stored)):
        return pa.table({"query_id": asked["query_id"].slice(0, 0), "vec_id": stored["vec_id"].slice(0, 0), "score": np.zeros(0)})
    q, v = (t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1) for t in (asked, stored))
    q_norm, norm = asked["norm"].to_numpy(), stored["norm"].to_numpy()
    place = pc.rank(stored["vec_id"], tiebreaker="dense").to_numpy()
    turned, own, hits, scores = (v / norm[:, None]).T, [], [], []
    for first in range(0, len(q), rows):
        part = slice(first, first + rows)
        rough = (q[part] / q_norm[part, None]) @ turned
        least = np.partition(rough, -k, axis=1)[:, -k, None] if k < len(v) else np.full((len(rough), 1), -np.inf)
        i, j = np.nonzero(~(rough < least - 1e-9))
        i += first
        dot = np.zeros(len(i))
        for d in range(q.shape[1]):
            dot += q[i, d] * v[j, d]
        score = dot / (q_norm[i] * norm[j])
        order = np.lexsort((place[j], np.where(np.isnan(score), -np.inf, -score), i))
        nth = np.arange(len(i)) - np.searchsorted(i, i)  # i ascends, before and after sorting
        order = order[nth < k]
        own.append(i[order]), hits.append(j[order]), scores.append(score[order])
    own, hits = pa.array(np.concatenate(own)), pa.array(np.concatenate(hits))
    return pa.table({"query_id": asked["query_id"].take(own), "vec_id": stored["vec_id"].take(hits), "score": np.concatenate(scores)})


def cosine_top_k(queries: DataFrame, vectors: DataFrame, limit: int = 10, query_id: str = "query_id", vec_id: str = "vec_id", embedding: str = "embedding", max_queries: int = 10_000, slice_rows: int = 8192) -> DataFrame:
    """(query_id, vec_id, score, rank) of the max(2 x limit, 20) nearest vectors by cosine; ties go to the smaller id.

    Any number of queries: they are dealt into blocks of about ``max_queries``, the vectors into slices of about
    ``slice_rows``; each block meets each slice in a task of bounded size, and the partial lists are merged. Vectors
    meet those of their own length.
    """
    k = max(2 * limit, 20)
    blocks, slices = (max(1, -(-df.count() // n)) for df, n in ((queries, max_queries), (vectors, slice_rows)))
    dot = F.aggregate(F.zip_with(embedding, embedding, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = lambda df, own, name: df.select(F.col(own).alias(name), F.col(embedding).alias("embedding"), F.size(embedding).alias("width"), F.sqrt(dot).alias("norm")).where("norm > 0")
    q = unit(queries, query_id, "query_id").withColumn("block", part("query_id", blocks)).withColumn("slice", each(slices))
    v = unit(vectors, vec_id, "vec_id").withColumn("slice", part("vec_id", slices)).withColumn("block", each(blocks))
    key = ["width", "block", "slice"]
    kinds = {f.name: f.dataType.simpleString() for f in (*q.schema, *v.schema)}
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double"
    best = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(lambda a, b: _best_of_slice(k, a, b), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_max(df: DataFrame, query_id: str, score: str, name: str) -> DataFrame:
    """``df`` with ``name``: the score between a query's least and largest; where all are equal, 1 if positive, else 0."""
    own = Window.partitionBy(query_id)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return df.withColumn(name, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise((F.col(score) > 0).cast("double")))


def fuse(vector: DataFrame, keyword: DataFrame, key: Sequence[str], weight: float = 0.7, query_id: str = "question_id") -> DataFrame:
    """(question_id, key, vector_score, keyword_score, fused): both sides normalised per query, blended by ``weight``.

    ``vector`` and ``keyword`` hold a column score; the best of repeated keys counts; a missing side is 0.
    """
    w = min(1.0, max(0.0, weight))
    side = lambda df, name: min_max(df.groupBy(query_id, *key).agg(F.max("score").alias("score")), query_id, "score", name).select(query_id, *key, name)
    both = side(vector, "vector_score").join(side(keyword, "keyword_score"), [query_id, *key], "full_outer")
    v, k = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("keyword_score", F.lit(0.0))
    return both.select(query_id, *key, v.alias("vector_score"), k.alias("keyword_score"), (w * v + (1 - w) * k).alias("fused"))


def rerank(fused: DataFrame, scores: DataFrame, key: Sequence[str], top: int = 20, query_id: str = "question_id") -> DataFrame:
    """Blends given rerank scores (question_id, key, rerank) of the ``top`` fused rows: 0.6 normalised rerank and 0.4
    fused; other rows have rerank 0. ``score`` orders the result."""
    order = Window.partitionBy(query_id).orderBy(F.desc("fused"), *key)
    ranked = fused.withColumn("__place", F.row_number().over(order)).join(scores, [query_id, *key], "left")
    chosen = min_max(ranked.where((F.col("__place") <= top) & F.col("rerank").isNotNull()), query_id, "rerank", "rerank_score").select(query_id, *key, "rerank_score")
    joined = ranked.drop("rerank").join(chosen, [query_id, *key], "left")
    score = F.when(F.col("rerank_score").isNotNull(), 0.6 * F.col("rerank_score") + 0.4 * F.col("fused")).otherwise(F.col("fused"))
    return joined.withColumn("score", score).withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0))).drop("__place")


def context_window(candidates: DataFrame, limit: int = 10, max_words: int = 4000, words_each: int = 350, query_id: str = "question_id", order: Sequence[str] = ("rank",), content: str = "content", carry: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Candidates that fit a budget of words, per query in order: content is cut to ``words_each`` words, a candidate
    that would pass ``max_words`` is skipped (later, shorter ones may fit), and ``limit`` ends it.

    All candidates count. Of those with one number of words only the first ``limit`` can be taken: what is left of the
    budget never grows, so where a later one fits, all before it fitted and ended the list. That bounds the list that
    is folded to ``limit`` times ``words_each``.
    """
    words = F.filter(F.split(F.trim(F.col(content)), r"(?U)\s+"), lambda w: F.length(w) > 0)
    kept = F.slice(words, 1, words_each)
    short = F.when(F.size(words) > words_each, F.array_join(kept, " ")).otherwise(F.col(content))
    rows = candidates.withColumns({"token_count": F.size(kept), content: short}).withColumn("__place", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
    rows = rows.select(query_id, "__place", *carry, content, "token_count")
    alike = Window.partitionBy(query_id, "token_count").orderBy("__place")
    rows = rows.where(F.col("token_count").between(1, max_words)).withColumn("__nth", F.row_number().over(alike)).where(F.col("__nth") <= limit)
    item = F.struct("__place", "token_count")
    lists = rows.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.struct(F.array().cast("array<int>").alias("places"), F.lit(0).alias("used"))

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["places"]) < limit) & (s["used"] + x["token_count"] <= max_words)
        return F.when(fits, F.struct(F.concat(s["places"], F.array(x["__place"])).alias("places"), (s["used"] + x["token_count"]).alias("used"))).otherwise(s)

    chosen = lists.select(query_id, F.explode(F.aggregate("items", empty, step, lambda s: s["places"])).alias("__place"))
    return rows.join(chosen, [query_id, "__place"]).select(query_id, F.col("__place").alias("place"), *carry, content, "token_count")


def limited(candidates: DataFrame, query_type: str = "query_type", query_id: str = "question_id", limits: Mapping[str, int] = TYPE_LIMITS, score: str = "score", content: str = "content", entity_id: str = "entity_id") -> DataFrame:
    """Candidates with content and a positive id, at most so many per query as its type allows."""
    order = Window.partitionBy(query_id).orderBy(F.desc(score), entity_id)
    most = F.coalesce(F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))[F.col(query_type)], F.lit(10))
    good = candidates.where((F.trim(F.col(content)) != "") & (F.col(entity_id) > 0))
    return good.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def retrieve(questions: DataFrame, documents: DataFrame, vector_scores: DataFrame, limit: int = 10, weight: float = 0.7, max_words: int = 4000, candidates: int = 200, top: int = 20) -> DataFrame:
    """Keyword scores of the ``candidates`` most recent documents, the ``top`` of each question fused with given vector
    scores (question_id, entity_type, entity_id, score), and the context window, for all questions."""
    key = ["entity_type", "entity_id"]
    keyword = best_per_question(bm25(questions, recent(documents, candidates)), top).drop("place").withColumnRenamed("bm25", "score")
    fused = fuse(vector_scores, keyword, key, weight).join(documents.select(*key, "content"), key)
    return context_window(fused, limit, max_words, order=[F.desc("fused"), *key], carry=[*key, "fused"])
