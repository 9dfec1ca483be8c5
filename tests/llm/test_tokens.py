import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from spendloom.llm.columns import text_blocks
from spendloom.llm.packing import best_two_fit, pack_documents, seats
from spendloom.llm.token_counts import compiled, read_spec, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Library.from_file(PATH)
HARD = [
    "", "a", " ", "  ", "don't stop 's 'r're 've'll 'l 'v'", " 's", "\n's", "\n\n  a", "a  \n", "x 　 y", "日本語テキスト 123abc", "it''s", "'lll'rve", "<|endoftext|>", "a <|endoftext|><|endoftext|> b",
    "=" * 300, "a" * 3000, "é à ñ \t\t\tq", "😀😀 x😀", "..' ..'s", "They'RE you'D", "  'tis", " " * 50 + "x", "'", "\x00\x1f ½ ²3 ́a", "word " * 5000,
]


def encoded(texts):
    arr = pa.array(texts, pa.string())
    ids, counts = [], []
    for _, _, data, offsets in text_blocks(arr, 500):
        t = compiled(read_spec(PATH))
        e, b = t.encode(data, offsets)
        ids += [e[x:y].tolist() for x, y in zip(b[:-1], b[1:], strict=True)]
        counts += t.count(data, offsets).tolist()
    return ids, counts


def test_equals_library_on_hard_texts():
    ids, counts = encoded(HARD)
    wanted = [LIBRARY.encode(t, add_special_tokens=False).ids for t in HARD]
    assert ids == wanted
    assert counts == [len(x) for x in wanted]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcthesnTRE'  \n\té日½1.#<|>😀"), max_size=60), max_size=4))
def test_equals_library_on_random_texts(texts):
    ids, counts = encoded(texts)
    assert ids == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts == [len(x) for x in ids]


def test_chunk_maps_compose():
    from spendloom.llm.transducer import Splitter

    data = np.frombuffer(("They'll  re-read 12 'ves\n\n done\xa0 " * 40).encode() + b"\xff", np.uint8)
    whole = Splitter(chunk=1 << 20).cuts(data)
    for chunk in (1, 2, 7, 64):
        part = Splitter(chunk=chunk).cuts(data)
        assert all((a == b).all() for a, b in zip(whole, part, strict=True))


def test_bounded_memory_forgets_and_agrees():
    from spendloom.llm.transducer import Tokenizer

    small = Tokenizer(read_spec(PATH), max_states=50)
    for t in HARD:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert small.count(raw, np.array([0, len(raw)]))[0] == len(LIBRARY.encode(t, add_special_tokens=False).ids)


def test_token_counts_edge_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (3, "hello world " * 300, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect()}
    n = len(LIBRARY.encode("hello world " * 300, add_special_tokens=False).ids)
    assert got == {(1, 0, 0, False), (None, 0, 0, False), (3, 3600, n, n > 512)}
    assert token_counts(df, PATH).count() == 4
    assert token_counts(df.limit(0), PATH).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # greedy fills 60 + 30; 22 + 18 fill the gap that 30 leaves exactly
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 22, 18]] = 1
    bins = best_two_fit(counts, 100)
    assert sorted(bins[0][0]) == [18, 22, 60]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_seats_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, np.int64)
    bins = best_two_fit(counts, 40)
    assert all(sum(b) <= 40 for b, _ in bins)
    used = np.zeros(41, np.int64)
    for b, k in bins:
        for n in b:
            used[n] += k
    assert (used == counts).all()
    assert sum(k for _, k in bins) <= max(1, 1.3 * -(-sum(lengths) // 40) + sum(1 for n in lengths if n > 20))
    assert len(seats(bins)) == sum(len(b) for b, _ in bins)


def check_packing(rows, texts, capacity=1024):
    by_doc = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r.start == at
            part = ids[at : at + r.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
        assert len(own) == -(-len(ids) // capacity)
    return len(bins)


def test_packing_round_trip(spark):
    texts = {1: None, 2: "", 3: "ab " * 700, 4: "q " * 5000, 5: "hello", **{k: "lorem ipsum " * (k % 90) for k in range(10, 400)}}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pack_documents(df, PATH).collect()
    bins = check_packing(rows, texts)
    total = sum(r.length for r in rows)
    assert bins <= 1.02 * total / 1024 + 1
    assert pack_documents(df.limit(0), PATH).count() == 0
    twice = pack_documents(df.where("doc_id = 4").unionByName(df.where("doc_id = 4")), PATH)
    assert twice.count() == 2 * len([r for r in rows if r.doc_id == 4])


@pytest.mark.parametrize("capacity", [16, 50])
def test_other_capacities(spark, capacity):
    df = spark.createDataFrame([(k, "w " * k) for k in range(60)], "doc_id long, text string")
    check_packing(pack_documents(df, PATH, capacity=capacity).collect(), {k: "w " * k for k in range(60)}, capacity)
