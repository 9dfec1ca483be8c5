"""Line-first cleaning: rules per line, failing lines go, documents that lose too much of their text go too."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.columns import fresh, named

#: What parts words, what words are, and the characters that count as symbols.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: A word belongs to a repeat if it lies in a window of so many words that the text has twice.
WINDOW = 5

#: Rules of lines. Marks that end a sentence; runs of marks; separators that stand alone between entries.
CLOSED = r"""[.!?…:;,"'»”)\]]""" + BLANK + r"*\z"
RUN_OF_MARKS = r"[!?]{2,}"
SEPARATOR = rf"(^|{BLANK})[|»›•·/>]+"
MENU = rf"^{BLANK}*(home|menu|login|log in|log out|sign in|sign up|register|contact us|contact|about us|about|next|previous|share|search|skip to|read more|back to top|sitemap)({BLANK}|\z)"
BOILERPLATE = r"(cookies? (policy|settings|notice)|(use|uses|accept|enable) cookies|enable javascript|all rights reserved|terms of (use|service)|terms and conditions|privacy policy|lorem ipsum|powered by|subscribe (to|now)|newsletter|click here|copyright \(c\)|©)"


@dataclass(frozen=True)
class LineRules:
    """When a line fails, and when its document does.

    punctuation: a line of fewer than ``least_words`` words without a mark at its end; one with two runs of marks or
    more, at more than ``marks_pct`` percent of its words; one with more than ``symbols_pct`` percent symbols among its characters.
    navigation: separators at more than ``separators_pct`` percent of its words; a line of up to ``menu_words`` words
    without a mark at its end that begins as menus do. boilerplate: a line of up to ``notice_words`` words with one of
    the phrases of notices. A document fails that loses more than ``lost_pct`` percent of its words with such lines.
    """

    least_words: int = 4
    marks_pct: int = 20
    symbols_pct: int = 10
    separators_pct: int = 20
    menu_words: int = 8
    notice_words: int = 40
    lost_pct: int = 40


def line_verdict(line: Column, words: Column, rules: LineRules) -> Column:
    """0 for a line that passes, 1, 2 or 3 for one that fails the rule of punctuation, navigation or boilerplate."""
    open_end = ~line.rlike(CLOSED)
    runs = F.regexp_count(line, F.lit(RUN_OF_MARKS))
    punctuation = ((words < rules.least_words) & open_end) | ((runs > 1) & (runs * 100 > words * rules.marks_pct))
    punctuation = punctuation | (F.regexp_count(line, F.lit(SYMBOL)) * 100 > F.char_length(line) * rules.symbols_pct)
    navigation = F.regexp_count(line, F.lit(SEPARATOR)) * 100 > words * rules.separators_pct
    navigation = navigation | ((words <= rules.menu_words) & open_end & F.lower(line).rlike(MENU))
    boilerplate = (words <= rules.notice_words) & F.lower(line).rlike(BOILERPLATE)
    return F.when(navigation, 2).when(boilerplate, 3).when(punctuation, 1).otherwise(0)




def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with clean_text, what was counted, and the verdicts.

    Counted over the whole text: n_words; word_chars, the code points in words; n_symbols; n_dup_lines, lines with a
    word that equal an earlier line; n_repeat_words, words in windows of five words that the text has twice or more,
    the first included; n_punctuation, n_navigation and n_boilerplate, the lines that fail each rule (see LineRules);
    lost_words, the words of those lines. clean_text is the text without them. base_failed: fewer than 10 words, or
    more than a fifth of the words repeated. kept: not base_failed, and at most ``rules.lost_pct`` percent of the words
    lost. Columns of ``docs`` with such a name keep it; the new ones get underscores.

    A null text has no words: clean_text is null, base_failed. An empty or blank one likewise, but for its clean_text.
    Repeated rows are judged each; an empty table gives no rows. Every row is worked on where it is read: nothing is
    shuffled, and the work grows with the length of a text, not its square (sorts aside). Windows count as equal if
    64 bits, less those for a place in the text, of their hash are; for texts of 500 words that is wrong once in about
    10^11 texts.
    """
    own = named(text)
    inner = {n: fresh(docs, f"__{n}") for n in ("words", "lines", "verdicts", "hashes", "bits", "sorted", "at")}
    out = {n: fresh(docs, n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_navigation", "n_boilerplate", "lost_words", "clean_text", "base_failed", "kept")}
    c = {k: F.col(f"`{v}`") for k, v in (inner | out).items()}
    there = F.coalesce(own, F.lit(""))
    words = F.regexp_extract_all(there, F.lit(WORD), F.lit(0))
    counted = F.transform(F.split(there, "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    # words' hashes and lines' words are kept as columns, so that no lambda computes them again for each element
    df = docs.withColumns({inner["words"]: F.transform(words, lambda x: F.xxhash64(x)), inner["lines"]: counted})
    # a line without a word has the verdict -1
    judged = F.transform(c["lines"], lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), F.when(x["n"] == 0, -1).otherwise(line_verdict(x["line"], x["n"], rules)).alias("v")))
    starts = F.sequence(F.lit(0), F.greatest(F.size(c["words"]) - WINDOW, F.lit(0)))
    window = lambda i: F.xxhash64(*(F.get(c["words"], i + k) for k in range(WINDOW)))
    df = df.withColumns({
        out["n_words"]: F.size(c["words"]).cast("long"), inner["verdicts"]: judged,
        inner["hashes"]: F.when(F.size(c["words"]) > WINDOW, F.transform(starts, window)).otherwise(F.array().cast("array<bigint>")),
        inner["bits"]: F.length(F.conv(F.size(c["words"]).cast("string"), 10, 2)),
    })
    # only texts with a repeat are sorted: hash and place share a long, so equal hashes stand side by side
    some = F.size(F.array_distinct(c["hashes"])) < F.size(c["hashes"])
    shifted = lambda h, i: F.call_function("shiftleft", h, c["bits"]).bitwiseOR(i.cast("long"))
    df = df.withColumn(inner["sorted"], F.when(some, F.sort_array(F.transform(c["hashes"], shifted))).otherwise(F.array().cast("array<bigint>")))
    part = lambda x: F.call_function("shiftright", x, c["bits"])
    beside = lambda x, k: F.coalesce(part(F.get(c["sorted"], k - 1)) == part(x), F.lit(False)) | F.coalesce(part(F.get(c["sorted"], k + 1)) == part(x), F.lit(False))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), c["bits"]) - 1)
    df = df.withColumn(inner["at"], F.sort_array(F.array_compact(F.transform(c["sorted"], lambda x, k: F.when(beside(x, k), place(x))))))
    zero = F.struct(F.lit(-WINDOW).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(c["at"], zero, lambda s, p: F.struct(p.alias("p"), (s["n"] + F.least(F.lit(WINDOW).cast("long"), p - s["p"])).alias("n")), lambda s: s["n"])
    spoken = F.transform(F.filter(c["lines"], lambda x: x["n"] > 0), lambda x: x["line"])
    failed = lambda v: F.size(F.filter(c["verdicts"], lambda x: x["v"] == v)).cast("long")
    lost = F.aggregate(c["verdicts"], F.lit(0).cast("long"), lambda s, x: s + F.when(x["v"] > 0, x["n"]).otherwise(0))
    passing = F.filter(c["verdicts"], lambda x: x["v"] <= 0)
    df = df.withColumns({
        out["word_chars"]: F.char_length(F.regexp_replace(there, f"{BLANK}+", "")).cast("long"), out["n_symbols"]: F.regexp_count(there, F.lit(SYMBOL)).cast("long"),
        out["n_dup_lines"]: (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long"), out["n_repeat_words"]: covered,
        out["n_punctuation"]: failed(1), out["n_navigation"]: failed(2), out["n_boilerplate"]: failed(3), out["lost_words"]: lost,
        out["clean_text"]: F.when(own.isNotNull(), F.array_join(F.transform(passing, lambda x: x["line"]), "\n")),
    })
    base = (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)
    df = df.withColumns({out["base_failed"]: base, out["kept"]: ~base & (c["lost_words"] * 100 <= c["n_words"] * rules.lost_pct)})
    return df.drop(*inner.values())


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def cleaning_sql(rules: LineRules = LineRules()) -> str:
    """What the query returns, as DuckDB SQL over ``documents``."""
    count = lambda pattern: f"len(regexp_extract_all(line, {_quoted(pattern)}))"
    like = lambda x, pattern: f"regexp_matches({x}, {_quoted(pattern)})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {_quoted(WORD)}) AS words FROM d),
win AS (SELECT r, i, words[i:i + {WINDOW - 1}] AS win FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
l AS (SELECT r, line, {count(WORD)} AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
v AS (SELECT r, line, n, CASE
    WHEN n = 0 THEN -1
    WHEN {count(SEPARATOR)} * 100 > n * {rules.separators_pct} OR (n <= {rules.menu_words} AND NOT {like("line", CLOSED)} AND {like("lower(line)", MENU)}) THEN 2
    WHEN n <= {rules.notice_words} AND {like("lower(line)", BOILERPLATE)} THEN 3
    WHEN (n < {rules.least_words} AND NOT {like("line", CLOSED)}) OR ({count(RUN_OF_MARKS)} > 1 AND {count(RUN_OF_MARKS)} * 100 > n * {rules.marks_pct}) OR {count(SYMBOL)} * 100 > length(line) * {rules.symbols_pct} THEN 1
    ELSE 0 END AS v FROM l),
s AS (SELECT r, count(*) FILTER (v = 1) AS n_punctuation, count(*) FILTER (v = 2) AS n_navigation, count(*) FILTER (v = 3) AS n_boilerplate,
    coalesce(sum(n) FILTER (v > 0), 0)::BIGINT AS lost_words, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM v GROUP BY r),
x AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, {_quoted(BLANK)}, '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, {_quoted(SYMBOL)}))::BIGINT AS n_symbols, n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    n_punctuation, n_navigation, n_boilerplate, lost_words
    FROM w JOIN s USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words * 100 <= n_words * {rules.lost_pct} AS kept
FROM x
"""
