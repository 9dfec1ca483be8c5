import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spendloom.llm.components import connected_components
from spendloom.llm.licences import scan_licences
from spendloom.llm.mixing import min_cost_flow, mix_sources, mixed_documents, water_fill
from spendloom.llm.near_dedup import near_duplicates, without_near_duplicates
from spendloom.llm.quality import held_out, score_quality
from spendloom.llm.repeats import repeated_passages, without_repeats
from spendloom.llm.sharding import shard_by_bytes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_copies(seed=1):
    """Texts with exact copies, chains of near copies, edge cases."""
    r = random.Random(seed)
    texts = {}
    n = 0
    for g in range(12):
        base = words(r.choice([3, 4, 5, 9, 60, 200]), g)
        for _ in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 3])):
                w[r.randrange(len(w))] = f"x{r.randrange(99999)}"
            texts[n] = " ".join(w)
            n += 1
        base = w
    for k in range(60):  # a large group, chained: each differs a little from the one before
        w = list(base) if k == 0 else w
        w[r.randrange(len(w))] = f"y{k}"
        texts[n] = "\n".join(w)
        n += 1
    texts |= {n: "", n + 1: None, n + 2: " \n\t ", n + 3: "One", n + 4: "one", n + 5: "ONE TWO", n + 6: "one  two"}
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    wanted = components(texts, links)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (wanted[i] == i) for i in texts)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    rows = near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter({(None, None, False): 1, (1, 1, True): 2, (2, 1, False): 1})
    assert near_duplicates(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in without_near_duplicates(df).collect()) == ["1", "None"]


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {x.id: x.component_id for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for a, b in links if a != b for i in (a, b)}
    assert got == components(ids, [(a, b) for a, b in links if a != b])


def passages(seed=3):
    r = random.Random(seed)
    shared = [" ".join(words(n, 100 + n, 100_000)) for n in (60, 75, 120)]
    texts = {}
    for k in range(40):
        own = words(200, 1000 + k, 100_000)
        if k % 4 == 0:
            at = r.randrange(len(own))
            own[at:at] = [shared[k // 4 % 3]]
        texts[k] = " ".join(own[:120]) + "\n" + " ".join(own[120:]) + "\nshort common line of only a few words"
    return texts, shared


def test_repeats_are_found_and_clean_documents_left_alone(spark):
    texts, shared = passages()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    rows = repeated_passages(df).collect()
    first = {s: min(i for i in texts if s in texts[i]) for s in shared}
    hit = defaultdict(int)
    for r in rows:
        part = texts[r.doc_id].encode()[r.start : r.start + r.length].decode().split()
        own = next(s for s in shared if s in texts[r.doc_id])
        assert r.kept_doc_id < r.doc_id and own in texts[r.kept_doc_id]
        assert len(part) == r.n_words
        hit[r.doc_id] += r.n_words
    assert set(hit) == {i for i in texts if i % 4 == 0} - set(first.values())
    cleaned = {r.doc_id: r for r in without_repeats(df).collect()}
    assert cleaned.keys() == texts.keys()
    for i, r in cleaned.items():
        if i not in hit:
            assert r.text == texts[i]
        else:
            assert len(r.text.split()) == len(texts[i].split()) - hit[i] and r.n_chars == len(r.text)


def test_repeats_edges(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (None, "a " * 50, "", "", 0), (2, "", "", "", 0)], SCHEMA)
    assert repeated_passages(df).count() == 0
    assert without_repeats(df).count() == 3
    assert repeated_passages(df.limit(0)).count() == 0
    same = " ".join(words(80, 9, 100_000))
    twice = spark.createDataFrame([(5, same, "", "", 0), (6, same, "", "", 0), (7, same, "", "", 0)], SCHEMA)
    assert {r.doc_id for r in without_repeats(twice).collect()} == {5}
    assert {(r.doc_id, r.kept_doc_id) for r in repeated_passages(twice).collect()} == {(6, 5), (7, 5)}


def test_repeats_on_given_documents(spark):
    """Nearly no passage of 51 words is left in two documents; documents that share nothing are untouched."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in without_repeats(docs).collect()}

    def shared(t, n):
        seen = defaultdict(set)
        for i, x in t.items():
            w = x.split()
            for k in range(len(w) - n + 1):
                seen[tuple(w[k : k + n])].add(i)
        return {h: v for h, v in seen.items() if len(v) > 1}

    before, left = shared(texts, 51), shared(after, 51)
    assert len(left) <= 0.01 * len(before)
    related = set().union(*shared(texts, 10).values())
    assert all(after[i] == t for i, t in texts.items() if i not in related)


def test_licences_run_no_python(spark):
    plan = scan_licences(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where(held_out())
    r = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count_if((F.col("quality") == 1) & (F.col("predicted") == 0)).alias("lost"), F.count_if(F.col("quality") == 1).alias("good")).first()
    assert r.right >= 0.97 and r.lost <= 0.03 * r.good
    one = docs.select("doc_id", held_out().alias("h")).where("doc_id < 50").collect()
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in one)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x"), (3, "long text " * 20000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_quality(df, none).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(k, "GOOD words " * 9 if k % 2 else "%%% ### " * 9) for k in range(40)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in score_quality(texts.unionByName(df.where("doc_id is null or doc_id = 3")), labels).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert score_quality(df.limit(0), none).count() == 0


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(0 <= s < shards for s in by)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_sharding_bytes(spark):
    r = random.Random(4)
    texts = {k: " ".join(words(r.randrange(1, 60), k)) for k in range(3000)}
    texts |= {k: "the same text" for k in range(5000, 6500)} | {k: f"pair {k // 2}" for k in range(8000, 8200)} | {9000: None, 9001: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("shard", F.lit("clash"))
    rows = shard_by_bytes(df).collect()
    assert {x.doc_id: (x.size, x.text_crc32) for x in rows} == {k: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts.items()}
    sizes = check_shards(rows, 16)
    assert len(sizes) == 16 and max(sizes.values()) <= 1.05 * min(sizes.values())
    of = defaultdict(set)
    for x in rows:
        if x.doc_id >= 8000 and x.doc_id < 9000:
            of[texts[x.doc_id]].add(x.shard)
    assert all(len(s) == 1 for s in of.values())
    again = {(x.doc_id, x.shard, x.slot) for x in shard_by_bytes(df.repartition(3)).collect()}
    assert again == {(x.doc_id, x.shard, x.slot) for x in rows}


def test_sharding_edges(spark):
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (2, "b" * 100_000)], "doc_id long, text string")
    assert check_shards(shard_by_bytes(df).collect(), 16)
    assert shard_by_bytes(df).count() == 4 and shard_by_bytes(df.limit(0)).count() == 0


def test_water_fill_and_flow():
    assert water_fill([100, 100, 100], [5, 2, 1], 300, 3) == [187.5, 75.0, 37.5]
    assert water_fill([10, 1000, 1000], [5, 2, 1], 2010, 3) == [30.0, 1320.0, 660.0]
    assert water_fill([0, 10], [5, 2], 10, 3) == [0.0, 10.0]
    flow = min_cost_flow([100, 100, 50], [[0], [0, 1], [1]], [150, 100], 3)
    assert flow.sum(axis=0).tolist() == [150, 100] and flow.sum(axis=1).tolist() == [100, 100, 50]
    assert min_cost_flow([10], [[0]], [100], 3).sum() == 30


def test_mixing(spark):
    r = random.Random(5)
    rows = [(k, " ".join(words(r.randrange(0, 50), k)), r.choice(["a", "b", "b", "b", "ü", "Z", None])) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix_sources(df).collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, _, x in rows if x == s) for s in sources}
    target = dict(zip(sources, water_fill([total[s] for s in sources], [5, 2, 1, 5, 2], sum(total.values()), 3), strict=True))
    of = {k: s for k, _, s in rows}
    taken = Counter()
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == total[of[x.doc_id]] and x.target == pytest.approx(target[of[x.doc_id]])
        assert x.taken % max(1, x.size) == 0 and x.taken <= 3 * x.size
        taken[of[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in sources)
    assert {(x.doc_id, x.taken) for x in mix_sources(df.repartition(7)).collect()} == {(x.doc_id, x.taken) for x in got}
    copies = Counter(x.doc_id for x in mixed_documents(df).collect())
    assert all(copies[x.doc_id] * x.size == x.taken for x in got)


def test_mixing_overlapping_sources(spark):
    rows = [(k, "w " * 10, [["a"], ["a", "b"], ["b"], []][k % 4]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mix_sources(df).collect()
    assert abs(sum(x.taken for x in got) - 4000) <= 60
    assert mix_sources(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, "", "a"), (2, "one word", "a"), (2, "one word", "a")], "doc_id long, text string, source string")
    assert mix_sources(nulls).count() == 4


def test_water_fill_by_hand():
    """160 words by 5 : 2 : 1 are 100, 40, 20; the second stops at 30, its 10 go on by 5 : 1."""
    assert water_fill([100, 10, 50], [5, 2, 1], 160, 3) == pytest.approx([100 + 50 / 6, 30, 20 + 10 / 6])
    assert water_fill([4, 4], [1, 1], 40, 3) == [12, 12] and water_fill([0, 5], [5, 2], 5, 3) == [0, 5]
