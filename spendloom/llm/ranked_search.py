"""Ranked lexical search: items' vocabulary tiles times tiles of document impacts, as dense products in float64."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendloom.llm.columns import cut, named, with_text_columns
from spendloom.llm.shingles import WordHasher

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No impact reaches this: (10^9 tf) div (1000 tf + 8 m) with m of 25 at least.
TOP_IMPACT = 1_000_000
#: Sums up to here are exact in float64.
EXACT = 1 << 53


class TermHasher(WordHasher):
    """64-bit hashes of terms; bytes of 0x80 and more belong to terms, as they are parts of characters beyond ASCII."""

    def __init__(self, seed: int = 1):
        super().__init__(seed)
        self.blank = np.ones(256, bool)
        for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
            self.blank[low:high] = False
        self.value = np.arange(1, 257, dtype=np.uint64)
        self.value[ord("A") : ord("Z") + 1] += np.uint64(32)
        self.value[self.blank] = 0


def flat_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of the given pieces, one after the other."""
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return data[at]


class Vocabulary:
    """Terms of the items; finds their numbers among the terms of texts."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.size = len(raw)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        for seed in range(1, 20):
            self.hasher = TermHasher(seed)
            hashes = self.hasher(self.data, self.offsets)[0] if raw else np.zeros(0, np.uint64)
            self.order = np.argsort(hashes, kind="stable")
            self.hashes = hashes[self.order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                break
        else:
            raise RuntimeError("terms share hashes under every seed")

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list:
        """Of each text: its number of terms, and the numbers and counts of those in the vocabulary."""
        hashes, starts, ends, first = self.hasher(data, offsets)
        n = np.diff(first)
        if not len(hashes) or not self.size:
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(n) + 1, np.int32)), pa.array(np.zeros(0, np.int32)))
            return [n.astype(np.int64), none, none]
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[hit]]
        # equal hashes are compared byte by byte
        sizes, own = ends[hit] - starts[hit], np.diff(self.offsets)[term]
        fit = sizes == own
        hit, term, sizes = hit[fit], term[fit], sizes[fit]
        if len(hit):
            lower = self.hasher.value
            same = lower[flat_bytes(data, starts[hit], sizes)] == lower[flat_bytes(self.data, self.offsets[term], sizes)]
            fit = np.logical_and.reduceat(same, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            hit, term = hit[fit], term[fit]
        text = np.searchsorted(first, hit, side="right") - 1
        key, tf = np.unique(text.astype(np.int64) * self.size + term, return_counts=True)
        bounds = pa.array(np.searchsorted(key, np.arange(len(n) + 1, dtype=np.int64) * self.size).astype(np.int32))
        return [n.astype(np.int64), pa.ListArray.from_arrays(bounds, pa.array((key % self.size).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))]


@dataclass
class Tile:
    """Some items by the few terms that they have: place[term of the vocabulary] is its row, or -1; ``parts`` are
    (first row, end row, weights [item, row]) such that no sum of a part's products reaches EXACT."""

    items: np.ndarray
    place: np.ndarray
    rows: int
    parts: list[tuple[int, int, np.ndarray]]


def tiles_of(item: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, n_items: int, tile_items: int, tile_terms: int) -> list[Tile]:
    """Tiles of ``tile_items`` items each, from their terms, how often they have them, and the terms' weights."""
    out = []
    worth = count.astype(np.int64) * weight[term]
    for low in range(0, n_items, tile_items):
        own = (item >= low) & (item < low + tile_items)
        terms, row = np.unique(term[own], return_inverse=True)
        place = np.full(len(weight), -1, np.int32)
        place[terms] = np.arange(len(terms))
        items = np.arange(low, min(n_items, low + tile_items))
        parts = []
        first = 0
        while first < len(terms):
            end = min(len(terms), first + tile_terms)
            while True:
                some = (row >= first) & (row < end)
                q = np.zeros((len(items), end - first), np.int64)
                q[item[own][some] - low, row[some] - first] = worth[own][some]
                if end == first + 1 or float(q.astype(np.float64).sum(axis=1).max()) * TOP_IMPACT < EXACT:
                    break
                end = first + (end - first) // 2
            # a single term that an item repeats so often goes in layers
            top = EXACT // TOP_IMPACT - 1
            while end == first + 1 and int(q.max()) > top:
                layer = np.minimum(q, top)
                parts.append((first, end, layer.astype(np.float64)))
                q = q - layer
            parts.append((first, end, q.astype(np.float64)))
            first = end
        out.append(Tile(items, place, len(terms), parts))
    return out


def middle(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document: 25 + (75 n N) div L."""
    if int(n.max(initial=0)) * 75 * docs < 1 << 63:
        return 25 + 75 * n * docs // total
    return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)


class Best:
    """The k best (score, smaller doc_id) of each item so far; ties at the cut are decided by doc_id, never by place."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.zeros(n_items, np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        r, c = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        if not len(r):
            return
        item, doc, score = (np.concatenate(x) for x in ((self.item, r), (self.doc, docs[c]), (self.score, scores[r, c])))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        self.item, self.doc, self.score = item[kept], doc[kept], score[kept]
        full = place == self.k - 1
        self.least[item[full]] = score[full]


def score_batches(batches: Iterator[pa.RecordBatch], tiles: list[Tile], item_id: np.ndarray, docs: int, total: int, k: int, tile_docs: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each item among a task's rows (doc_id, n, terms, counts)."""
    best = [Best(len(tile.items), k) for tile in tiles]
    for batch in batches:
        doc_id, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists, counts = batch.column(2), batch.column(3)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        m = middle(n, docs, total)
        text = np.repeat(np.arange(len(n)), np.diff(bounds))
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[text])
        for low in range(0, len(n), tile_docs):
            high = min(len(n), low + tile_docs)
            own = slice(bounds[low], bounds[high])
            for tile, kept in zip(tiles, best, strict=True):
                row = tile.place[term[own]]
                here = row >= 0
                dense = np.zeros((tile.rows, high - low))
                dense[row[here], text[own][here] - low] = impact[own][here]
                score = np.zeros((len(tile.items), high - low), np.int64)
                for first, end, q in tile.parts:
                    score += (q @ dense[first:end]).astype(np.int64)
                kept.add(doc_id[low:high], score)
    for tile, kept in zip(tiles, best, strict=True):
        if len(kept.item):
            yield pa.RecordBatch.from_arrays([pa.array(item_id[tile.items[kept.item]]), pa.array(kept.doc), pa.array(kept.score)], names=["item_id", "doc_id", "score"])


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    round_terms: int = 500_000, tile_items: int = 64, tile_terms: int = 2_048, tile_docs: int = 512,
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. N counts
    the documents with a term, L all their terms, df the documents that hold a term. A term's weight is floor(1000
    ln((2 N + 2) / (2 df + 1))); a document's m is 25 + (75 n N) div L with its n terms; the score sums, over an item's
    terms with repeats, weight * ((10^9 tf) div (1000 tf + 8 m)). Equal scores go by the smaller doc_id.

    Texts are read once: each becomes the numbers and counts of its terms in the items' vocabulary, kept in the
    checkpoint folder. Tiles of ``tile_items`` items have a compact vocabulary of their own; a tile's weights are
    multiplied with impacts of ``tile_docs`` documents, ``tile_terms`` terms at a time and fewer where a sum could
    reach 2^53, so every product is exact in float64; the parts are added as 64-bit integers. A task hands on its ``k``
    best of each item; those are merged by salted ranks.

    The items' (item, term) pairs are dealt into rounds of about ``round_terms``; only one round's vocabulary, weights
    and item ids are with the driver and the tasks at a time, and more rounds read the texts again.

    Null texts have no terms; a document without one counts in nothing. Rows with a null doc_id count in N, L and df
    but can't be listed; repeated rows count and are listed each. A null item_id asks nothing; an item_id that comes
    with several texts asks the smallest one. Items without a term that a document has give no rows, nor do empty
    tables.
    """
    asked = items.where(named(item_id).isNotNull()).groupBy(named(item_id).cast("long").alias("item_id")).agg(F.min(named(item_text)).alias("text"))
    asked = asked.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    pairs = cut(asked.groupBy("item_id", "term").count())
    rounds = max(1, -(-pairs.count() // round_terms))
    found = None
    for r in range(rounds):
        # bounded by round_terms, but for a single item with more terms
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).toPandas()
        one = _round(docs, own, k, doc_id, text, tile_items, tile_terms, tile_docs)
        found = one if found is None else found.unionByName(one)
    order = [F.desc("score"), F.asc("doc_id")]
    part = Window.partitionBy("item_id", "part").orderBy(*order)
    best = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    whole = Window.partitionBy("item_id").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _round(docs: DataFrame, own, k: int, doc_id: str, text: str, tile_items: int, tile_terms: int, tile_docs: int) -> DataFrame:
    """Each task's best documents for some items; ``own`` has their (item_id, term, count)."""
    terms, term = np.unique(own["term"].to_numpy(dtype=object).astype(str), return_inverse=True)
    item_id, item = np.unique(own["item_id"].to_numpy(np.int64), return_inverse=True)
    vocabulary = Vocabulary(list(terms))
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    fields = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    index = cut(with_text_columns(rows, "text", fields, lambda: vocabulary.postings).where("n > 0"))
    n_docs, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(terms), np.int64)
    # a row for each term of the round
    for t, df in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weight[t] = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))
    tiles = tiles_of(item, term, own["count"].to_numpy(np.int64), weight, len(item_id), tile_items, tile_terms)
    held = index.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).select("doc_id", "n", "terms", "counts")
    return held.mapInArrow(lambda batches: score_batches(batches, tiles, item_id, n_docs, total, k, tile_docs), "item_id long, doc_id long, score long")


SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
s AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
tot AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM s),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM s) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, tot),
b AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM b) GROUP BY ALL),
m AS (SELECT r, doc_id, 25 + (75 * n::BIGINT * nd) // l AS m FROM s, tot),
x AS (SELECT q.item_id, m.r, any_value(m.doc_id) AS doc_id, sum(q.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r GROUP BY q.item_id, m.r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
