"""Keyword top-k of very many questions over very many documents: documents are indexed in the task that scores them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.functions import text as tx
from spendloom.sources.shared import bound_batches, kept, let_go

#: Scores are summed in another order than bounds; so much of a bound is added to it.
SLACK = 1e-9
#: Tokens in a COMMON-th of the documents or more are common; their bounds are those of blocks of BLOCK documents.
COMMON, BLOCK = 16, 32
#: Rows of common tokens hold so many parts (64 MB) at most.
ROWS = 1 << 23
#: So many scores and parts of scores are worked on at a time.
CELLS = 1 << 20
#: Documents are told apart by the logarithm of their length, in so many steps for a doubling.
STEPS = 4


def _dealt(sizes: Mapping[int, int], counts: Mapping[int, int], top: int, shard_tokens: int, head_part: int, head_shards: int) -> list[tuple[int, int]]:
    """(least class, shards) of groups of length classes, longest documents first; the first group is the head."""
    groups, tokens, docs, least = [], 0, 0, sum(sizes.values()) / head_part
    for k in sorted(sizes, reverse=True):
        tokens, docs = tokens + sizes[k], docs + counts[k]
        if not groups and tokens >= least and docs >= top:
            groups.append((k, max(-(-tokens // shard_tokens), min(head_shards, -(-docs // top)))))
        elif groups and tokens >= shard_tokens:
            groups.append((k, -(-tokens // shard_tokens)))
        else:
            continue
        tokens = docs = 0
    return [*groups, (min(sizes), max(1, -(-tokens // shard_tokens)))] if docs else groups


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal values."""
    ends = [*(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip([0, *ends[:-1]], ends, strict=True)) if len(values) else []


class _Shard:
    """Postings of the documents of a shard, shortest document first: those of token k are from ``ends[k]`` to
    ``ends[k + 1]``, each with the token's number times ``width`` plus the document's as its place, and its part."""

    def __init__(self, key: Sequence[str], mean: float, k1: float, b: float):
        self.key, self.mean, self.k1, self.b = key, mean, k1, b
        self.batches: list[tuple] = []
        self.width = 0

    def add(self, batch: pa.RecordBatch) -> None:
        lists = pc.split_pattern(batch.column("words"), " ")
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        own, tf = np.unique(row * len(words) + code, return_counts=True)
        row, code = own // max(len(words), 1), own % max(len(words), 1)
        length, boost = batch.column("len").to_numpy()[row], batch.column("boost").to_numpy()[row]
        part = np.log1p(tf) * (tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))) * boost
        self.batches.append((pa.Table.from_batches([batch]).select(list(self.key)), words, code, (row + self.width).astype(np.int32), part, batch.column("len").to_numpy()))
        self.width += len(batch)

    def built(self) -> _Shard:
        if self.batches:
            tables, words, codes, pos, parts, lengths = zip(*self.batches, strict=True)
            merged = pa.chunked_array(words).combine_chunks().dictionary_encode()
            at = np.split(merged.indices.to_numpy(), np.cumsum([len(x) for x in words])[:-1])
            code = np.concatenate([x[c] for x, c in zip(at, codes, strict=True)])
            self.words, self.keys = merged.dictionary, pa.concat_tables(tables)
            # documents come in the order of their keys
            self.rank = np.argsort(np.concatenate(lengths), kind="stable")
            pos = np.argsort(self.rank)[np.concatenate(pos)]
            place = code.astype(np.int64) * self.width + pos
            order = np.argsort(place)
            self.part, self.place = np.concatenate(parts)[order], place[order]
            self.ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.words)))])
            self.tops: dict[int, np.ndarray] = {}
            self.row, self.rows, self.n_rows = np.full(len(self.words), -1), np.zeros((0, self.width)), 0
            self.batches = []
        return self

    def top_of_blocks(self, code: int) -> np.ndarray:
        """The largest part that a token has in each block of documents."""
        if code not in self.tops:
            own = slice(self.ends[code], self.ends[code + 1])
            out = np.zeros(-(-self.width // BLOCK))
            np.maximum.at(out, (self.place[own] - code * self.width) // BLOCK, self.part[own])
            self.tops[code] = out
        return self.tops[code]

    def part_of(self, codes: np.ndarray, r: np.ndarray, d: np.ndarray) -> np.ndarray:
        """What the tokens ``codes[r]`` add to the documents ``d``; from rows of all documents, as long as these are few."""
        for k in np.unique(codes).tolist():
            if self.row[k] < 0 and (self.n_rows + 1) * self.width <= ROWS:
                if self.n_rows == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros((max(8, min(self.n_rows, ROWS // self.width - self.n_rows)), self.width))])
                own = slice(self.ends[k], self.ends[k + 1])
                self.rows[self.n_rows, self.place[own] - k * self.width] = self.part[own]
                self.row[k], self.n_rows = self.n_rows, self.n_rows + 1
        row = self.row[codes]
        if (row >= 0).all():
            return self.rows[row[r], d]
        looked = codes[r] * self.width + d
        hit = np.minimum(np.searchsorted(self.place, looked), len(self.place) - 1)
        return np.where(self.place[hit] == looked, self.part[hit], 0.0)

    def best(self, batch: pa.RecordBatch, n_docs: int, top: int, digits: int | None) -> pa.RecordBatch | None:
        """The ``top`` best documents of each question that may be among its best: those that reach its ``least``.

        Scores of rare tokens are added up for all documents. What the common ones may add is bounded by block; only
        documents that reach the least with that are scored. A question without a least has all its tokens added up.
        The order of the sum is the same in all shards: rare tokens first, then common ones, so equal documents get
        equal sums.
        """
        lists = pc.split_pattern(batch.column("words"), " ")
        sizes = np.diff(lists.offsets.to_numpy())
        code = pc.index_in(lists.flatten(), value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        times, df = (batch.column(c).flatten().to_numpy() for c in ("times", "df"))
        weight = times * np.log1p((n_docs - df + 0.5) / (df + 0.5))
        least = batch.column("least").fill_null(-1.0).to_numpy()
        owner, open_ = np.repeat(np.arange(len(batch)), sizes), least >= 0
        common = df >= n_docs / COMMON
        held = np.lexsort((common, owner))
        held = held[code[held] >= 0]
        owner, code, weight, common = owner[held], code[held], weight[held], common[held]
        slack = 0.0 if digits is None else 10.0**-digits  # what a score may be under the rounded one
        need = np.where(open_, np.maximum(least * (1 - SLACK) - slack, 0), 0.0)
        hits = np.where(common & open_[owner], 0, self.ends[code + 1] - self.ends[code])
        # as many questions at a time as have about CELLS documents and hits together
        cost = np.cumsum(np.bincount(owner, hits, minlength=len(batch)) + self.width)
        q, found, scores = [], [], []
        for low, high in _runs(cost // CELLS):
            mine = slice(np.searchsorted(owner, low), np.searchsorted(owner, high))
            at, tokens, w, late = owner[mine] - low, code[mine], weight[mine], (common & open_[owner])[mine]
            n = self.ends[tokens + 1] - self.ends[tokens]
            n[late] = 0
            where = np.repeat(self.ends[tokens] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = self.place[where] + np.repeat((at - tokens) * self.width, n)
            total = np.bincount(cell, np.repeat(w, n) * self.part[where], minlength=(high - low) * self.width).astype(np.float64, copy=False).reshape(high - low, -1)
            if late.any():
                kinds, kind = np.unique(tokens[late], return_inverse=True)
                factor = np.zeros((high - low, len(kinds)))
                factor[at[late], kind] = w[late]
                bound = factor @ np.stack([self.top_of_blocks(k) for k in kinds.tolist()])
                # the least that a document needs of the rare tokens
                short = np.repeat(need[low:high, None] - bound * (1 + SLACK), BLOCK, axis=1)[:, : self.width]
                r, d = np.nonzero(total >= short)
            else:
                r, d = np.nonzero(total > 0)
            score = total[r, d]
            if late.any():
                # the common tokens of a question side by side, in their order; what is left over weighs nothing
                nth = np.arange(late.sum()) - np.searchsorted(at[late], at[late])
                rows, factors = np.zeros((nth.max() + 1, high - low), np.int64), np.zeros((nth.max() + 1, high - low))
                rows[nth, at[late]], factors[nth, at[late]] = tokens[late], w[late]
                for codes, x in zip(rows, factors, strict=True):
                    score += x[r] * self.part_of(codes, r, d)
            shown = score if digits is None else np.round(score, digits)
            keep = np.flatnonzero((score > 0) & (shown >= least[low:high][r]))
            keep = keep[np.lexsort((self.rank[d[keep]], -shown[keep], r[keep]))]
            keep = keep[np.arange(len(keep)) - np.searchsorted(r[keep], r[keep]) < top]
            q.append(r[keep] + low), found.append(self.rank[d[keep]]), scores.append(shown[keep])
        if not q:
            return None
        asked, rows = batch.column("question_id").take(pa.array(np.concatenate(q))), self.keys.take(pa.array(np.concatenate(found))).combine_chunks()
        columns = [asked, *(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in rows.columns), pa.array(np.concatenate(scores))]
        return pa.RecordBatch.from_arrays(columns, names=["question_id", *self.key, "score"])


def bm25_best(
    questions: DataFrame, documents: DataFrame, top: int, boosts: Mapping[str, float], digits: int | None = None, other: float = 0.8, k1: float = 1.5, b: float = 0.75, key: Sequence[str] = ("entity_type", "entity_id"),
    content: str = "content", question_id: str = "question_id", question: str = "text", shard_tokens: int = 6_000_000, head_part: int = 16, head_shards: int = 8,
) -> DataFrame:
    """(question_id, key, bm25, place) of the ``top`` best documents of each question, all documents counted; scores and
    ties as in ``keyword_index.bm25_top``.

    Documents of like length are dealt into shards of about ``shard_tokens`` tokens. Every question meets every shard, as
    one row. A shard's postings are made in the task that scores it and are written nowhere, so disk has the texts once
    and the questions once a shard. The longest documents, a ``head_part``-th of all tokens, come first; the last of a
    question's best there is the least that the other shards look for. Memory of a task: a shard and a batch of
    questions. Work grows with the product of questions and documents, as the scores do.
    """
    bound_batches(documents.sparkSession)
    key = list(key)
    # an array's only element is made once, and not again in the filters after it
    tokens = lambda c: F.explode(F.array(tx.tokens(F.coalesce(F.col(c), F.lit(""))))).alias("tokens")
    docs = documents.select(*key, tokens(content)).withColumn("len", F.greatest(F.size("tokens"), F.lit(1)))
    docs = docs.withColumn("class", F.floor(F.log2("len") * STEPS).cast("int"))
    sizes = {r["class"]: (r["n"], r["tokens"]) for r in docs.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).collect()}
    n_docs, n_tokens = sum(n for n, _ in sizes.values()), sum(t for _, t in sizes.values())
    asked = questions.select(F.col(question_id).alias("question_id"), tokens(question)).select("question_id", F.explode("tokens").alias("token"))
    asked = asked.groupBy("question_id", "token").agg(F.count(F.lit(1)).cast("int").alias("times"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    lists = asked.join(df, "token").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("token", "times", "df"))).alias("x"))
    asked = kept(lists.select("question_id", F.array_join("x.token", " ").alias("words"), F.col("x.times").alias("times"), F.col("x.df").cast(f"array<{'int' if n_docs < 1 << 31 else 'long'}>").alias("df")))

    groups = _dealt({k: t for k, (_, t) in sizes.items()}, {k: n for k, (n, _) in sizes.items()}, top, shard_tokens, head_part, head_shards) or [(0, 1)]
    shard: Column = F.lit(-1)
    first = [sum(n for _, n in groups[:k]) for k in range(len(groups) + 1)]
    for (low, n), at in reversed(list(zip(groups, first, strict=False))):
        shard = F.when(F.col("class") >= low, at + F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")).otherwise(shard)
    boost = F.coalesce(*(F.when(F.col(key[0]) == k, F.lit(float(v))) for k, v in boosts.items()), F.lit(float(other)))
    dealt = docs.select(shard.alias("shard"), F.lit(0).alias("kind"), *key, F.array_join("tokens", " ").alias("words"), "len", boost.alias("boost")).where("words <> ''")
    kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema, *dealt.schema)}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("question_id", *key)) + ", score double"
    mean = max(n_tokens / max(n_docs, 1), 1.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            at = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            for low, high in _runs(at):
                if at[low] // 2 != now:
                    now, index = at[low] // 2, _Shard(key, mean, k1, b)
                rows = batch.slice(low, high - low)
                if at[low] % 2 == 0:
                    index.add(rows)
                elif index.width and (out := index.built().best(rows, n_docs, top, digits)) is not None:
                    yield out

    def scored(low: int, high: int, questions: DataFrame) -> DataFrame:
        """Questions (with ``least``) against the shards from ``low`` to ``high``: a shard's documents come before its questions."""
        met = questions.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).withColumn("kind", F.lit(1))
        both = dealt.where(F.col("shard").between(low, high - 1)).unionByName(met, allowMissingColumns=True)
        # as many partitions as keep most shards apart; they come in the order of their keys, so that the first of equal scores is the right one
        return both.repartition(4 * (high - low), "shard").sortWithinPartitions("shard", "kind", *key).mapInArrow(work, schema)

    nth = Window.partitionBy("question_id").orderBy(F.desc("score"), *key)
    best = kept(scored(0, first[1], asked.withColumn("least", F.lit(None).cast("double"))))
    if len(groups) > 1:
        let_go(documents.sparkSession)  # of the shuffles so far
        least = best.withColumn("n", F.row_number().over(nth)).where(F.col("n") == top).select("question_id", F.col("score").alias("least"))
        best = best.unionByName(scored(first[1], first[-1], asked.join(least, "question_id", "left")))
    return best.withColumn("place", F.row_number().over(nth)).where(F.col("place") <= top).withColumnRenamed("score", "bm25").select("question_id", *key, "bm25", "place")
