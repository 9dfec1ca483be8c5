"""Operators and stages against plainer versions of what they compute, and stages on awkward rows."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.llm import quality as q
from spendloom.llm.repeats import repeated_passages, without_repeats
from spendloom.llm.sharding import shard_by_bytes


def plain_logit(net, text):
    """The network written out: windows, chunks, maxima, one text at a time."""
    n = max(1, -(-(len(text) - q.WIDTH) // q.STRIDE) + 1)
    padded = text + bytes(2 * q.WIDTH)
    table = np.einsum("be,kef->kbf", net.p["embed"], net.p["kernel"])
    response = np.array([sum(table[k][padded[q.STRIDE * i + k]] for k in range(q.WIDTH)) for i in range(n)])
    hidden = []
    low = 0
    while True:
        own = response[low : low + q.CHUNK]
        z = np.append(np.maximum(own.max(axis=0) + net.p["bias"], 0), len(own) / q.CHUNK)
        hidden.append(np.maximum(z @ net.p["w1"] + net.p["b1"], 0))
        if low + q.CHUNK >= n:
            break
        low += q.CHUNK - q.OVERLAP
    hidden = np.array(hidden)
    return np.concatenate([hidden.max(axis=0), hidden.mean(axis=0)]) @ net.p["w2"] + net.p["b2"][0]


def block(texts):
    return q.Windows(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def some_texts(sizes, seed=4):
    r = np.random.default_rng(seed)
    return [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in sizes]


def test_network_equals_plain_version():
    net = q.Network(3)
    texts = some_texts([0, 1, 7, 8, 9, 10, 11, 127, 134, 135, 136, 1029, 1030, 1031, 1032, 1033, 5000, 0, 70_001])
    logit, _ = net.forward(block(texts), np.float64)
    assert np.allclose(logit, [plain_logit(net, t) for t in texts])
    single, _ = net.forward(block(texts))
    assert np.allclose(single, logit, atol=1e-3)


def test_gradient_equals_differences():
    net = q.Network(5)
    w = block(some_texts([0, 30, 700, 3000, 90]))
    y, weight = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 0.5, 1])
    _, g = net.gradient(w, y, weight, np.float64)
    r = np.random.default_rng(1)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for k in r.choice(len(flat), min(12, len(flat)), replace=False):
            old, step = flat[k], 1e-6
            flat[k] = old + step
            up, _ = net.gradient(w, y, weight, np.float64)
            flat[k] = old - step
            down, _ = net.gradient(w, y, weight, np.float64)
            flat[k] = old
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[k]) < 1e-5, name


def plant(seed, passages, length, line=True):
    """Documents of random words, some with a passage of ``length`` words; passage k is in documents 2k and 2k + 1."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts, planted = {}, {}
    for k in range(passages):
        own = [word() for _ in range(length)]
        for i in (2 * k, 2 * k + 1):
            before, after = [word() for _ in range(60)], [word() for _ in range(60)]
            sep = " " if line else "\n"
            texts[i] = " ".join(before) + sep + " ".join(own) + sep + " ".join(after)
        planted[2 * k + 1] = own
    return texts, planted


def taken(texts, rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = texts[r.doc_id].encode()[r.start : r.start + r.length].decode().split()
        assert len(part) == r.n_words
        out.setdefault(r.doc_id, []).extend(part)
    return out


@pytest.mark.parametrize("line", [True, False])
def test_passages_are_cut_word_by_word(spark, line):
    texts, planted = plant(7, 150, 55, line)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = taken(texts, repeated_passages(df).collect())
    # what is found is the passage; where a piece at its rim is a near copy of a longer one, a few words more or less
    assert set(found) <= set(planted)
    exact = sum(planted[i] == w for i, w in found.items())
    print(len(found), exact, [len(w) for i, w in found.items() if planted[i] != w])
    assert exact >= 0.85 * len(found) and all(len(set(w) & set(planted[i])) >= 45 and len(w) <= 70 for i, w in found.items())
    assert len(found) >= 0.96 * len(planted)


def test_passages_below_the_least_length_stay(spark):
    texts, _ = plant(8, 60, 44, False)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert repeated_passages(df).count() == 0


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, `a.b` string, size int, `key` string, variant string, marks int, plan int, __text string, pattern string"


def awkward(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    shared = " ".join(word() for _ in range(80))
    tail = " ".join(word() for _ in range(20))
    long = " ".join(word() for _ in range(200_000))
    texts = [(1, "one é text " + shared), (1, "öther text of the same id " * 3 + shared), (2, f"{shared} {tail}"), (2, f"{shared} {tail}"), (3, long), (None, shared), (None, None), (4, None), (5, ""), (6, " \n\t"), (7, shared), (8, "few words")]
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), 7.0, "mine", "dotted", 3, "k", "v", 1, 2, "own", "p") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, AWKWARD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    docs = awkward(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {None, *range(1, 9)}
        return
    assert out.columns == docs.columns
    assert all((r.score, r.predicted, r["a.b"], r.size, r.key, r.variant, r.marks, r.plan, r["__text"], r.pattern) == (7.0, "mine", "dotted", 3, "k", "v", 1, 2, "own", "p") for r in rows)
    texts = sorted(str((r.doc_id, r.text)) for r in rows)
    before = sorted(str((r.doc_id, r.text)) for r in docs.collect())
    if name == "near_dedup":
        assert len(rows) == 9 and {r.doc_id for r in rows} == {None, 1, 3, 4, 5, 6, 8}
    if name == "substring_dedup":
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r.text)
        assert sorted(map(str, by[None])) == sorted(map(str, [r.text for r in docs.where("doc_id is null").collect()]))
        full = docs.where("doc_id = 2").first().text
        assert all(full.endswith(t) and len(t) > 60 for t in by[2]) and len(by[2]) == 2 and 7 not in by and by[4] == [None] and len(by[1]) == 2
        assert sum("one é" in t for t in by[1]) == 1 and sum("öther" in t for t in by[1]) == 1
    if name in ("quality", "mixing"):
        assert set(texts) <= set(before)
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_repeats_without_a_size_column(spark):
    df = awkward(spark).select("doc_id", "text", F.col("`a.b`").alias("c.d"))
    assert without_repeats(df).columns == ["doc_id", "text", "c.d"]


def test_sharding_equals_plain_version(spark):
    """All rows in key order, running bytes, groups of equal texts as one unit unless they are large; no splitters."""
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(900)}" for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(1500)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k, texts[k % 7]) for k in range(2000, 2400)] + [(k, "hot " * 9) for k in range(3000, 3900)] + [(4000, None), (4001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = [(x.h, x.doc_id, x.size) for x in df.select(F.xxhash64("text").alias("h"), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")).collect()]
    keyed.sort()
    target = sum(s for _, _, s in keyed) / 16
    at, units, run = [], {}, 0
    for h, _, size in keyed:
        at.append(run)
        low, total, copies = units.get(h, (run, 0, 0))
        units[h] = (low, total + size, copies + 1)
        run += size
    wanted, seen = {}, {}
    for (h, doc, size), own in zip(keyed, at, strict=True):
        low, total, copies = units[h]
        if copies > 1 and total <= 0.005 * target:
            own, size = low, total
        shard = min(int((own + size / 2) // target), 15)
        wanted[doc] = (shard, seen.get(shard, 0))
        seen[shard] = seen.get(shard, 0) + 1
    got = {x.doc_id: (x.shard, x.slot) for x in shard_by_bytes(df).collect()}
    assert got == wanted
