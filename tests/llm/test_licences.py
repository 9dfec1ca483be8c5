"""Licence scan on statements that are neither templates nor made from the model's frames, and against a plain version."""

import math
import re

from pyspark.sql import functions as F

from spendloom.llm.licences import LICENCES, SHORT, _starts, default_model, grams_of, scan_licences, windows_of, words_of

SF = "/root/testdata/sf0.001"

#: Written for this test.
STATED = [
    ("MIT", "(MIT)"), ("CC0-1.0", "CC0-1.0"), ("Unlicense", "The Unlicense"), ("EPL", "Eclipse Public License 2.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"),
    ("MIT", "The software is provided as is, without warranty of any kind, express or implied"),
    ("AGPL-3.0", "This server is free software under the AGPL v3 or later"), ("BSD", "BSD-style license"), ("BSD", "Released under BSD-3-Clause"),
    ("CC-BY-SA", "CC BY-SA 4.0"), ("GPL-3.0", "under GPLv3"), ("ISC", "ISC licensed"), ("MIT", "You can use this library under the MIT licence."),
    ("CC0-1.0", "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Example."),
    ("GPL-2.0", "This module may be distributed under the terms of the GNU General Public License (GPL) version 2."),
    ("LGPL", "libfoo is LGPL, so you can link to it from proprietary programs"), ("Apache-2.0", "Contributions are accepted under the Apache 2 license"),
    ("CC-BY", "Text and figures: Creative Commons Attribution 4.0"), ("CC-BY-NC", "Images may be reused under CC BY-NC 4.0 with credit"),
]
NOT_STATED = [
    "The driver lost the license on Monday.", "Our general terms apply to all public orders.", "Permission was granted to build on the site.", "Copyright law protects works of art.",
    "The commons voted on the public license fee for television", "a thsh license tion", "He is free to copy the picture and publish it", "The library is open to the public", "license " * 4000,
]


def plain(text):
    """(probability, family) of a paragraph: its best window, of equal ones the first."""
    model, best = default_model(), None
    for w in windows_of(words_of(text)):
        grams = list(dict.fromkeys(grams_of(w)))
        own = [sum(model.weights[g][k] for g in grams if g in model.weights) / math.sqrt(max(1, len(grams))) + model.bias[k] for k in range(len(model.families))]
        if best is None or max(own) > max(best):
            best = own
    return 1 / (1 + math.exp(-(model.slope * max(best) + model.offset))), model.families[best.index(max(best))]


def test_statements_of_every_kind(spark):
    filler = "alpha beta gamma delta. " * 60
    rows = [(k, t) for k, (_, t) in enumerate(STATED)] + [(100 + k, f"Some words first.\n{filler}{t}. {filler}\nand last") for k, (_, t) in enumerate(STATED)]
    rows += [(200 + k, t) for k, t in enumerate(NOT_STATED)] + [(901, None), (902, ""), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit(1))
    got = scan_licences(df).collect()
    known = {r.doc_id: r for r in got if r.family != "unknown"}
    right = [known.get(k) is not None and known[k].family == f for k, (f, _) in enumerate(STATED)]
    assert sum(right) >= len(STATED) - 1, [t for ok, t in zip(right, STATED, strict=True) if not ok]
    # inside long paragraphs too, where the statement has more than three words
    inside = [known.get(100 + k) is not None and known[100 + k].family == f for k, (f, t) in enumerate(STATED) if len(words_of(t)) > 5]
    assert sum(inside) >= 0.7 * len(inside)
    assert all(known[100 + k].start == 18 for k in range(len(STATED)) if 100 + k in known)
    assert sum(200 + k in known for k in range(len(NOT_STATED))) <= 1 and None in known
    assert not any(r.doc_id in (901, 902) for r in got) and scan_licences(df.limit(0)).count() == 0


def test_wrapped_text_and_templates(spark):
    texts = [(f, t) for f, (_, _, ts) in LICENCES.items() for t in ts]
    wrap = lambda t: re.sub(r"((?:\S+ ){7})", r"\1\n", t).replace(" \n", "\n")
    df = spark.createDataFrame([(k, wrap(t)) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in scan_licences(df).collect():
        if r.family != "unknown":
            got.setdefault(r.doc_id, set()).add((r.family, r.confirmed))
    assert sum((f, True) in got.get(k, ()) for k, (f, _) in enumerate(texts)) >= 0.9 * len(texts)


def test_scan_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = default_model()
    wanted = {}
    for r in docs.collect():
        joined = re.sub(r"(?<=[^.!?:;\s])\n(?=\S)", " ", r.text or "")
        start = 0
        for k, line in enumerate(joined.split("\n")):
            own = set(words_of(line)) & set(model.anchors)
            if len(words_of(line)) <= SHORT and own or len(own) > 1 or own - set(model.weak):
                wanted[r.doc_id, k, start] = plain(line)
            else:
                assert plain(line)[0] < 0.6
            start += len(line) + 1
    got = {(r.doc_id, r.paragraph, r.start): r for r in scan_licences(docs).collect()}
    assert got.keys() == wanted.keys() and len(got) > 10
    assert all(abs(got[k].probability - p) < 1e-6 and got[k].family == (f if p >= 0.6 else "unknown") for k, (p, f) in wanted.items())


def test_many_licence_lines_of_one_text(spark):
    lines = [f"Line {k} is under the MIT License here." for k in range(15_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = scan_licences(df).agg(F.count(F.lit(1)), F.sum("start"), F.min("family"), F.max("family"), F.max("paragraph")).first()
    assert tuple(got) == (15_000, sum(_offsets(lines)), "MIT", "MIT", 14_999)


def _offsets(lines):
    at = 0
    for x in lines:
        yield at
        at += len(x) + 1


def test_starts_are_running_sums(spark):
    for n in (1, 2, 255, 256, 257, 1000):
        sizes = [(7 * k) % 31 + 1 for k in range(n)]
        got = spark.createDataFrame([(sizes,)], "x array<long>").select(_starts(F.col("x")).alias("s")).first().s
        assert got == [sum(sizes[:k]) for k in range(n)]
