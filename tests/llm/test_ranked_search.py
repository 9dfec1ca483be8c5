"""Ranked search against a plain version, on awkward rows and in small tiles."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendloom.llm.ranked_search import EXACT, TOP_IMPACT, Best, Vocabulary, ranked_search, tiles_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    kept = [(i, Counter(t), len(t)) for i, t in ((i, terms_of(x)) for i, x in docs) if t]
    n, total = len(kept), sum(x for *_, x in kept)
    df = Counter(t for _, c, _ in kept for t in c)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked[i] = min(t, asked.get(i, t))
    out = []
    for i, text in asked.items():
        scores = []
        for d, c, size in kept:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def frames(spark, docs, items):
    extra = "doc_id long, text string, n long, terms string, score double, item_id int, `a.b` string"
    d = spark.createDataFrame([(i, t, 1, "x", 2.0, 3, "y") for i, t in docs], extra)
    return d, spark.createDataFrame([(i, t, "own", 1.0) for i, t in items], "item_id long, text string, term string, doc_id double")


def some(seed, n):
    r = random.Random(seed)
    words = ["Éta", "éta", "the", "THE", "a1", "x²", "日本", "q", "wörd", "naïve"] + ["".join(r.choice("abcde") for _ in range(3)) for _ in range(60)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-", "_", "  "]) for _ in range(k))
    return [(i, text(r.randrange(0, 60))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"tile_items": 2, "tile_terms": 3, "tile_docs": 5, "round_terms": 40}])
def test_equals_plain_version_on_awkward_rows(spark, sizes):
    docs = some(1, 120)
    docs += [(7, docs[7][1]), (7, "other text of id 7 the"), (None, "the éta of no id"), (200, None), (201, ""), (202, " .,;\n"), (203, "the " * 30_000 + "q"), (204, "z" * 200_000), (205, docs[3][1]), (206, docs[3][1])]
    items = [(i, t) for i, t in some(2, 12)] + [(3, "the q the q"), (None, "the"), (50, None), (51, ""), (52, "nowhereword"), (53, "the the THE Éta éta"), (53, "the the THE Éta éta"), (54, "z" * 200_000)]
    d, q = frames(spark, docs, items)
    rows = ranked_search(d, q, **sizes).collect()
    assert sorted(map(tuple, rows)) == plain(docs, items)


def test_empty_tables(spark):
    d, q = frames(spark, [], [])
    full, ask = frames(spark, [(1, "a b")], [(1, "a")])
    assert ranked_search(d, ask).count() == 0 and ranked_search(full, q).count() == 0 and ranked_search(d, q).count() == 0
    assert ranked_search(full, ask).columns == ["item_id", "rank", "doc_id", "score"]


def test_all_documents_tie(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)]
    d, q = frames(spark, docs, [(1, "words")])
    assert [r.doc_id for r in sorted(ranked_search(d, q, tile_docs=7).collect(), key=lambda r: r.rank)] == list(range(1, 11))


def test_partial_sums_stay_exact():
    # a term repeated so often that its weight alone would pass 2^53 is dealt into layers
    count, weight = np.array([3_000_000, 5, 2_000_000]), np.array([20_000, 19_000])
    tiles = tiles_of(np.array([0, 0, 1]), np.array([0, 1, 0]), count, weight, 2, 64, 2048)
    total = np.zeros((2, 2), np.int64)
    for first, end, q in tiles[0].parts:
        assert q.sum(axis=1).max() * TOP_IMPACT < EXACT
        total[:, first:end] += q.astype(np.int64)
    assert total.tolist() == [[3_000_000 * 20_000, 5 * 19_000], [2_000_000 * 20_000, 0]]


def test_best_keeps_ties_by_id():
    best = Best(1, 2)
    best.add(np.array([9, 8, 7]), np.array([[5, 5, 5]]))
    best.add(np.array([3, 4]), np.array([[5, 4]]))
    assert best.doc.tolist() == [3, 7]


def test_terms_with_equal_hashes_are_told_apart():
    v = Vocabulary(["abc", "zz"])
    v.hashes = v.hasher(np.frombuffer(b"qqqzz", np.uint8), np.array([0, 3, 5]))[0]
    v.order = np.array([0, 1])[np.argsort(v.hashes)]
    v.hashes = np.sort(v.hashes)
    n, terms, counts = v.postings(np.frombuffer(b"qqq zz qqq ZZ", np.uint8), np.array([0, 13]))
    assert n.tolist() == [4] and terms.to_pylist() == [[1]] and counts.to_pylist() == [[2]]
