"""Line-first cleaning against a plain version of its counts, on lines made for each rule, on awkward rows."""

import random
import re
from collections import Counter

import duckdb
import pytest

from spendloom.llm.line_rules import LineRules, clean_lines, cleaning_sql

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(repeated))


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "bb", "ü", "日本", "x&y", "#", "*", "𝒳", "the"] + ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(r.choice([3, 40]))]
    seps = [" "] * 8 + ["\n", "\t", "\r\n", "  ", "\x0b", "\n \n", " "]
    return ["".join(r.choice(words) + r.choice(seps) for _ in range(r.randrange(0, 80))) for _ in range(n)]


def test_counts_equal_plain_version(spark):
    all_texts = [*texts(1, 60), *texts(2, 60), *texts(3, 60), None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 30_000, "line one\n" * 3, " ".join(map(str, range(40_000))), "a" * 300_000]
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in clean_lines(docs).collect()}
    for i, t in enumerate(all_texts):
        assert tuple(rows[i][c] for c in COUNTS) == plain(t), (i, t and t[:200])
        n, repeated = rows[i].n_words, rows[i].n_repeat_words
        assert rows[i].base_failed == (n < 10 or 100 * repeated > 20 * n)


GOOD = "This is a sentence that says something and ends as one should."
BAD = {
    "n_punctuation": ["Chapter", "Word three here", "LOOK!! AT!! THIS!! NOW!!", "odd&&& words### with%%% marks***", "what?? is?? this?? here"],
    "n_navigation": ["Home | News | Sport | Weather | Travel.", "one » two » three.", "Skip to the main content", "  Log in", "• first • second •."],
    "n_boilerplate": ["We use cookies to make this site work.", "© 2020 Somebody.", "All Rights Reserved by the owner of it.", "Please enable JavaScript to view the comments.", "Lorem ipsum dolor sit amet, consectetur."],
}
FINE = ["A title of four words", "Home is where the heart is, they say.", "She asked: what?!", "a | b in a line of very many words is no menu, as it goes on and on.", "Yes.", "(one)", "The cookies that she baked were good."]


@pytest.mark.parametrize("rule", BAD)
def test_lines_that_fail(spark, rule):
    docs = spark.createDataFrame([(i, f"{GOOD}\n{line}\n\n{GOOD}") for i, line in enumerate(BAD[rule])], "doc_id long, text string")
    for r in clean_lines(docs).collect():
        assert r[rule] == 1 and r.n_punctuation + r.n_navigation + r.n_boilerplate == 1, (r.text, r)
        assert r.clean_text == f"{GOOD}\n\n{GOOD}" and r.lost_words == len(BAD[rule][r.doc_id].split())


def test_lines_that_pass(spark):
    text = "\n".join(FINE)
    r = clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.clean_text == text and r.lost_words == 0 and r.kept


def test_documents_fail_by_what_they_lose(spark):
    own = [" ".join(f"w{k}x{j}" for j in range(10)) + "." for k in range(10)]
    bad = [" ".join(f"m{k}x{j}!!" for j in range(10)) for k in range(10)]
    docs = spark.createDataFrame([(n, "\n".join(bad[:n] + own[n:])) for n in range(11)], "doc_id long, text string")
    assert {r.doc_id for r in clean_lines(docs).where("kept").collect()} == {0, 1, 2, 3, 4}
    assert {r.doc_id for r in clean_lines(docs, LineRules(lost_pct=75)).where("kept").collect()} == set(range(8))


def test_awkward_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "x", 2, "y", 3), (None, "a b", 1, "x", 2, "y", 3), (4, None, 1, "x", 2, "y", 3)], "doc_id long, text string, n_words int, `a.b` string, __words int, `kept` string, `__at` int")
    out = clean_lines(docs)
    assert out.columns[:7] == docs.columns and "n_words_" in out.columns and "kept_" in out.columns
    rows = out.collect()
    assert len(rows) == 3 and all((r.n_words, r["a.b"], r["__words"], r.kept, r.__getitem__("__at")) == (1, "x", 2, "y", 3) for r in rows)
    assert sorted((r.n_words_, r.kept_, r.clean_text) for r in rows if r.text) == [(2, False, None or "")] * 2 and [r.clean_text for r in rows if r.text is None] == [None]
    assert clean_lines(docs.limit(0)).count() == 0


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = clean_lines(spark.read.parquet(path).select("doc_id", "text")).drop("text", "clean_text")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    want = con.sql(cleaning_sql())
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
