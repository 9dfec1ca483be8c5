"""Repeated passages that are laid out in short lines."""

import random

from spendloom.llm.repeats import repeated_passages


def words(r, n):
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]


def lines(r, sizes):
    return "\n".join(" ".join(words(r, n)) for n in sizes)


def gone(spark, passage):
    r = random.Random(9)
    docs = [(k, f"{lines(r, [30, 25])}\n{passage}\n{lines(r, [28, 40])}") for k in range(4)]
    found = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = {k: t.encode() for k, t in docs}
    cut = {k: "".join(texts[k][x.start : x.start + x.length].decode() for x in found if x.doc_id == k).split() for k in texts}
    assert not cut[0] and all(set(cut[k]) <= set(passage.split()) for k in cut)
    return [len(cut[k]) for k in (1, 2, 3)]


def test_verse_is_found(spark):
    assert gone(spark, lines(random.Random(1), [5] * 40)) == [200] * 3


def test_short_lines_do_not_break_a_run(spark):
    assert gone(spark, lines(random.Random(2), [12, 5] * 12)) == [149] * 3  # the twelve long lines, and the short one at the end
