"""Each stage on what the stage before it kept, against a plainer version; and the whole run."""

import re
from collections import Counter

import corpus_pipeline
from spendloom.llm.mixing import water_fill
from spendloom.llm.quality import score_quality

from .test_text_operators import components, shingles
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{name}")
        before = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert before.columns == columns
    raw = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id: r.text for r in kept["quality"].collect()}
    scores = {r.doc_id: r.predicted for r in score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good == {i: t for i, t in raw.items() if scores[i] == 1}

    sets = {i: shingles(t) for i, t in good.items()}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    once = {r.doc_id: r.text for r in kept["near_dedup"].collect()}
    assert once == {i: good[i] for i, c in components(ids, links).items() if i == c}

    clean = {r.doc_id: r for r in kept["substring_dedup"].collect()}
    assert clean.keys() <= once.keys() and len(clean) >= 0.98 * len(once)
    assert all(len(r.text) == r.n_chars for i, r in clean.items() if r.text != once[i])

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in clean.items()}
    sources = sorted({r.source for r in clean.values()})
    total = [sum(size[i] for i, r in clean.items() if r.source == s) for s in sources]
    target = water_fill(total, [(5, 2, 1)[k % 3] for k in range(len(sources))], sum(total), 3)
    mixed = kept["mixing"].collect()
    taken = Counter()
    for r in mixed:
        assert r.text == clean[r.doc_id].text
        taken[r.source] += size[r.doc_id]
    largest = {s: max(size[i] for i, r in clean.items() if r.source == s) for s in sources}
    assert all(abs(taken[s] - t) <= largest[s] for s, t in zip(sources, target, strict=True))
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3

    rows = kept["packing"].collect()
    alone = {i: r.text for i, r in clean.items()}
    copies = Counter(r.doc_id for r in mixed)
    first = [r for r in rows if copies[r.doc_id] == 1]
    by_sequence = Counter()
    for r in rows:
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= 1024
    pieces = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert all(n == copies[d] for (d, *_), n in pieces.items())
    assert {r.doc_id for r in rows} == set(copies)
    assert first and len(alone) > 0
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == pieces


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
    assert check_packing([], {}) == 0
