"""Repeated passages by paragraph MinHash banding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendloom.llm.columns import bound_batches, cut, fresh, map_arrow, named, of_ids, split_of_ids, text_blocks, with_text_columns
from spendloom.llm.components import connected_components
from spendloom.llm.near_dedup import links_left, verified
from spendloom.llm.shingles import ShingleHasher, distinct, mix, odd_numbers

PARAGRAPHS = T.ArrayType(T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("fp", T.LongType())]))
#: Sides of a paragraph.
LEFT, RIGHT = 0, 1


class Paragraphs:
    """Cuts texts into paragraphs and sketches them.

    A paragraph is a line, or a part of a long line: a line is cut before a word whose hash with the word before it is
    the largest among the ``reach`` words on either side. That depends on those words alone, so a passage is cut alike
    wherever it stands. Neighbouring lines under ``min_words`` words are joined and cut as one line, before the first
    word of a line rather than elsewhere. No cut leaves a piece under ``min_words`` words; only a lone short line, or
    joined ones that are still short, are left out, and are not numbered.
    """

    def __init__(self, reach: int, min_words: int, bands: int):
        self.reach, self.min_words, self.bands = reach, min_words, bands
        self.shingles = ShingleHasher()
        self.factor, self.shift = odd_numbers(bands, 6), odd_numbers(bands, 7)
        self.place = odd_numbers(1 << 12, 8)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """text, nth (of its text), words, fp, low and high (words of the block) of each paragraph, in order; word (hash)
        and at (start byte) of each word, and the first word of each text."""
        word, starts, ends, first = self.shingles.hasher(data, offsets)
        n, w = len(word), self.reach
        empty = np.zeros(0, np.int64)
        if not n:
            return {"word": word, "at": starts, "first": first, **dict.fromkeys(("text", "nth", "words", "low", "high"), empty), "fp": empty.astype(np.uint64)}
        lines = np.cumsum(data == 10, dtype=np.int32)
        own_line = lines[starts]
        cut_here = np.ones(n, bool)
        cut_here[1:] = own_line[1:] != own_line[:-1]
        cut_here[first[:-1][first[:-1] < n]] = True
        edges = np.flatnonzero(cut_here)
        short = np.diff(np.append(edges, n)) < self.min_words
        joined = np.zeros(len(edges), bool)
        joined[1:] = short[1:] & short[:-1]
        joined &= first[np.searchsorted(first, edges)] != edges  # a text starts anew
        inner, edges = edges[joined], edges[~joined]
        cut_here[inner] = False
        size = np.diff(np.append(edges, n))
        since = np.arange(n) - np.repeat(edges, size)
        until = np.repeat(size, size) - since
        before = np.concatenate([word[:1], word[:-1]])
        h = mix(word + np.uint64(3) * before) >> np.uint64(1)
        h[inner] |= np.uint64(1 << 63)
        margin = max(w, self.min_words)
        top = (since >= margin) & (until >= margin)
        for k in range(1, w + 1):
            top[k:] &= h[k:] > h[:-k]
            top[:-k] &= h[:-k] >= h[k:]
        cut_here |= top
        low = np.flatnonzero(cut_here)
        high = np.append(low[1:], n)
        text = np.searchsorted(first, low, side="right") - 1
        keep = high - low >= self.min_words
        low, high, text = low[keep], high[keep], text[keep]
        nth = np.arange(len(low)) - np.searchsorted(text, text)
        words = high - low
        longest = int(words.max(initial=0))
        if longest > len(self.place):
            self.place = odd_numbers(1 << longest.bit_length(), 8)
        at = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
        seq = np.add.reduceat(word[np.repeat(low, words) + at] * self.place[at], np.cumsum(words) - words) if len(low) else np.zeros(0, np.uint64)
        fp = mix(seq + words.astype(np.uint64))
        return {"word": word, "at": starts, "first": first, "text": text, "nth": nth, "words": words, "fp": fp, "low": low, "high": high}

    def runs(self, p: dict[str, np.ndarray], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the 5-word runs of the picked paragraphs, and their bounds."""
        words = p["words"][pick]
        bounds = np.concatenate([[0], np.cumsum(words)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], words)
        return self.shingles.runs_of(p["word"][np.repeat(p["low"][pick], words) + at], bounds)

    def keys(self, p: dict[str, np.ndarray], pick: np.ndarray) -> np.ndarray:
        """[band, paragraph] keys; a band is one minhash."""
        values, bounds = self.runs(p, pick)
        out = np.zeros((self.bands, len(pick)), np.uint64)
        for k in range(self.bands):
            out[k] = mix(np.minimum.reduceat((values ^ self.shift[k]) * self.factor[k], bounds[:-1]) + np.uint64(k + 1)) if len(pick) else 0
        return out


    def around(self, p: dict[str, np.ndarray], k: int, side: int, most: int) -> np.ndarray:
        """Up to ``most`` words beside paragraph ``k``, the nearest first, as 32-bit hashes."""
        text = p["text"][k]
        if side == LEFT:
            own = p["word"][max(p["first"][text], p["low"][k] - most) : p["low"][k]][::-1]
        else:
            own = p["word"][p["high"][k] : min(p["first"][text + 1], p["high"][k] + most)]
        return own.astype(np.uint32).view(np.int32)

    def passages(self, p: dict[str, np.ndarray], offsets: np.ndarray, text: int, base: int, marks: list[dict], beside: list[dict], min_run: int, gap: int) -> list[tuple[int, int, int, int, int, int]]:
        """(run, start, length, words, component, kept document) of the spans to remove from a text, in order.

        ``marks`` are its repeated paragraphs by number, ``beside`` the words beside their kept copies at the ends of
        the runs. A run grows by the words that equal those beside its copy; runs at most ``gap`` words apart count as
        one, and those under ``min_run`` words stay. A lone short line within a run stays.
        """
        words = {(x["paragraph"], x["side"]): np.array(x["words"], np.int32) for x in beside}
        runs: list[list[list]] = []
        last = None
        for m in marks:
            k = base + m["paragraph"]
            span = [int(p["low"][k]), int(p["high"][k]), m]
            if last is None or m["paragraph"] != last + 1:
                runs.append([span])
            elif runs[-1][-1][1] == span[0]:
                runs[-1][-1][1] = span[1]
            else:
                runs[-1].append(span)
            last = m["paragraph"]
            runs[-1][-1].append(last)
        floor = int(p["first"][text])
        ends = [run[0][0] for run in runs[1:]] + [int(p["first"][text + 1])]
        for run, ceiling in zip(runs, ends, strict=True):
            for side, span, number in ((LEFT, run[0], run[0][3]), (RIGHT, run[-1], run[-1][-1])):
                theirs = words.get((number, side))
                if theirs is None:
                    continue
                own = self.around(p, base + number, side, min(len(theirs), span[0] - floor if side == LEFT else ceiling - span[1]))
                differs = np.flatnonzero(own != theirs[: len(own)])
                n = int(differs[0]) if len(differs) else len(own)
                if side == LEFT:
                    span[0] -= n
                else:
                    span[1] += n
            floor = run[-1][1]
        size = [sum(s[1] - s[0] for s in run) for run in runs]
        group = np.cumsum([0] + [int(b[0][0] - a[-1][1] > gap) for a, b in zip(runs, runs[1:], strict=False)])
        total = np.bincount(group, size) if runs else []
        out = []
        for k, run in enumerate(runs):
            if total[group[k]] >= min_run:
                for low, high, m, *_ in run:
                    start = int(p["at"][low] - offsets[text])
                    end = int((p["at"][high] if high < p["first"][text + 1] else offsets[text + 1]) - offsets[text])
                    out.append((int(group[k]), start, end - start, high - low, m["component_id"], m["kept_doc_id"]))
        return out


def paragraph_rows(docs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(doc_id, variant, paragraph, n_words, fp) of each paragraph."""

    def make():
        cutter = Paragraphs(*shape)

        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            p = cutter(data, offsets)
            ends = np.searchsorted(p["text"], np.arange(len(offsets)))
            parts = [p["nth"].astype(np.int32), p["words"].astype(np.int32), p["fp"].view(np.int64)]
            each = pa.StructArray.from_arrays([pa.array(x) for x in parts], names=[f.name for f in PARAGRAPHS.elementType.fields])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)]

        return compute

    return with_text_columns(docs, "text", [T.StructField("p", PARAGRAPHS)], make).select("doc_id", "variant", F.inline("p"))


#: Slots for paragraphs that a task has given the band keys of (8 bytes each).
REMEMBERED = 1 << 20


def band_rows(docs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(l, fp): band keys of the paragraphs. What stands in a task's slot for a paragraph is not given out again, so
    boilerplate comes about once a task, not once a block of texts."""

    def work(batches):
        cutter = Paragraphs(*shape)
        # no paragraph of a slot equals what the slot begins with
        given = np.arange(1, REMEMBERED + 1, dtype=np.uint64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                p = cutter(data, offsets)
                fp, pick = np.unique(p["fp"], return_index=True)
                slot = (fp % np.uint64(REMEMBERED)).astype(np.int64)
                new = given[slot] != fp
                given[slot] = fp
                fp, pick = fp[new], pick[new]
                if not len(fp):
                    continue
                keys = cutter.keys(p, pick)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(fp.view(np.int64), len(keys)))], names=["l", "fp"])

    return docs.select("text").mapInArrow(work, "l long, fp long")


def paragraph_sets(docs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(fp, shingles) of each paragraph of ``docs``; its few shingles are told apart by 32 bits of their hashes."""

    def make():
        cutter = Paragraphs(*shape)

        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            p = cutter(data, offsets)
            values, bounds = distinct(*cutter.runs(p, np.arange(len(p["fp"]))))
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.uint32).view(np.int32)))
            each = pa.StructArray.from_arrays([pa.array(p["fp"].view(np.int64)), sets], names=["fp", "shingles"])
            return [pa.ListArray.from_arrays(pa.array(np.searchsorted(p["text"], np.arange(len(offsets))), pa.int32()), each)]

        return compute

    field = T.ArrayType(T.StructType([T.StructField("fp", T.LongType()), T.StructField("shingles", T.ArrayType(T.IntegerType()))]))
    return with_text_columns(docs, "text", [T.StructField("p", field)], make).select(F.inline("p"))


def beside_rows(docs: DataFrame, wanted: DataFrame, shape: tuple[int, int, int], most: int) -> DataFrame:
    """(kept_doc_id, kept_variant, kept_paragraph, side, words): the words beside the ``wanted`` paragraphs of ``docs``."""
    keys = ["kept_doc_id", "kept_variant"]
    asked = wanted.groupBy(*keys).agg(F.collect_list(F.struct("kept_paragraph", "side")).alias("asked"))
    texts = docs.select(F.col("doc_id").alias(keys[0]), F.col("variant").alias(keys[1]), "text")
    texts = of_ids(texts, wanted.select(keys[0]).distinct(), keys[0]).join(asked, keys).select(*keys, "asked", "text")
    schema = "kept_doc_id long, kept_variant int, kept_paragraph int, side int, words array<int>"
    bound_batches(docs.sparkSession)

    def work(batches):
        cutter = Paragraphs(*shape)
        for batch in batches:
            ids, variants = (batch.column(k).to_numpy() for k in (0, 1))
            for low, high, data, offsets in text_blocks(batch.column(3)):
                p = cutter(data, offsets)
                base = np.searchsorted(p["text"], np.arange(high - low)).tolist()
                rows = []
                for k, asked in enumerate(batch.column(2).slice(low, high - low).to_pylist()):
                    for x in asked:
                        rows.append((ids[low + k], variants[low + k], x["kept_paragraph"], x["side"], cutter.around(p, base[k] + x["kept_paragraph"], x["side"], most)))
                if rows:
                    one, two, three, four, lists = zip(*rows, strict=True)
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int32()), pa.array(three, pa.int32()), pa.array(four, pa.int32()), words], names=[*keys, "kept_paragraph", "side", "words"])

    return texts.mapInArrow(work, schema).dropDuplicates([*keys, "kept_paragraph", "side"])


def repeated_components(docs: DataFrame, shape: tuple[int, int, int], percent: int) -> DataFrame:
    """(fp, component_id, kept_doc_id) of the paragraphs whose component more than one document has."""
    rows = paragraph_rows(docs, shape)
    keyed = band_rows(docs, shape).repartition("l")
    mixed = keyed.groupBy("l").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    meeting = cut(keyed.join(mixed.select("l", "low"), "l").distinct())
    near = meeting.select("fp").distinct().withColumn("meets", F.lit(True))
    classes = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    classes = cut(classes.join(near, "fp", "left").where("copies > 1 or meets"))
    wanted = classes.where("meets").select(F.col("first_doc").alias("doc_id")).distinct()
    sets = paragraph_sets(of_ids(docs.select("doc_id", "text"), wanted, "doc_id"), shape)
    sets = cut(sets.join(near.select("fp").hint("shuffle_hash"), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles")).withColumnRenamed("fp", "doc_id"))
    star = cut(meeting.where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct())
    links = cut(verified(star, sets, percent))
    components = connected_components(links)
    groups = meeting.select("l", F.col("fp").alias("rep")).join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    apart = groups.groupBy("l").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y").select("l")
    rest = cut(links_left(cut(groups.join(apart, "l")), sets, percent))
    if not rest.isEmpty():
        components = connected_components(links.unionByName(rest))
    named_ = classes.join(components.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component_id", F.coalesce("component_id", "fp"))
    whole = named_.groupBy("component_id").agg(F.max("last_doc").alias("last_doc"), F.min("first_doc").alias("kept_doc_id")).where("last_doc <> kept_doc_id")
    return named_.select("fp", "component_id").join(whole.select("component_id", "kept_doc_id"), "component_id")


def marked_documents(docs: DataFrame, shape: tuple[int, int, int], percent: int, min_found: int, min_run: int) -> DataFrame:
    """(doc_id, variant, marks, beside): the repeated paragraphs of each document that has any, in order, and the words
    beside the kept copies of those that begin or end a run. ``docs`` has doc_id, variant and text."""
    found = cut(paragraph_rows(docs, shape).join(repeated_components(docs, shape, percent), "fp"))
    kept = found.where(F.col("doc_id") == F.col("kept_doc_id")).groupBy("component_id").agg(F.min(F.struct("variant", "paragraph")).alias("k"))
    found = found.join(kept.select("component_id", F.col("k.variant").alias("kept_variant"), F.col("k.paragraph").alias("kept_paragraph")), "component_id")
    itself = (F.col("doc_id") == F.col("kept_doc_id")) & (F.col("variant") == F.col("kept_variant")) & (F.col("paragraph") == F.col("kept_paragraph"))
    found = found.where(~itself).distinct()
    # repeats in a row have consecutive numbers
    run = F.col("paragraph") - F.row_number().over(Window.partitionBy("doc_id", "variant").orderBy("paragraph"))
    found = found.withColumn("run", run).withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "variant", "run")))
    mark = F.struct("paragraph", "component_id", "kept_doc_id", "kept_variant", "kept_paragraph")
    marks = cut(found.where(F.col("run_words") >= min_found).groupBy("doc_id", "variant").agg(F.array_sort(F.collect_set(mark)).alias("marks")))

    def edges(side: int):
        step = -1 if side == LEFT else 1
        alone = lambda x, k: F.coalesce(F.get("marks", k + step)["paragraph"], F.lit(-2)) != x["paragraph"] + step
        return F.transform(F.filter("marks", alone), lambda x: F.struct(x["paragraph"].alias("paragraph"), F.lit(side).alias("side"), x["kept_doc_id"].alias("kept_doc_id"), x["kept_variant"].alias("kept_variant"), x["kept_paragraph"].alias("kept_paragraph")))

    # a document that repeats itself does not grow into its own kept copy
    ends = marks.select("doc_id", "variant", F.explode(F.concat(edges(LEFT), edges(RIGHT))).alias("e")).select("doc_id", "variant", "e.*").where("doc_id <> kept_doc_id")
    keys = ["kept_doc_id", "kept_variant", "kept_paragraph", "side"]
    beside = beside_rows(docs, ends.select(*keys).distinct(), shape, min_run)
    beside = ends.join(beside, keys).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("paragraph", "side", "words")).alias("beside"))
    return cut(marks.join(beside, ["doc_id", "variant"], "left"))


def of_passages(texts: DataFrame, shape: tuple[int, int, int], min_run: int, gap: int, schema: T.StructType, made: Callable) -> DataFrame:
    """What ``made(rows, bytes, offsets, spans of each)`` returns for blocks of ``texts`` (columns, then marks, beside and the text)."""
    bound_batches(texts.sparkSession)

    def work(batches):
        cutter = Paragraphs(*shape)
        for batch in batches:
            n = batch.num_columns
            for low, high, data, offsets in text_blocks(batch.column(n - 1)):
                p = cutter(data, offsets)
                base = np.searchsorted(p["text"], np.arange(high - low)).tolist()
                marks, beside = (batch.column(k).slice(low, high - low).to_pylist() for k in (n - 3, n - 2))
                spans = [cutter.passages(p, offsets, k, base[k], marks[k], beside[k] or [], min_run, gap) if marks[k] else [] for k in range(high - low)]
                yield pa.RecordBatch.from_arrays(made(batch.slice(low, high - low), data, offsets, spans), names=schema.names)

    return map_arrow(texts, work, schema)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(named(doc_id).cast("long").alias("doc_id"), F.hash(named(text)).alias("variant"), named(text).alias("text")).where(F.col("doc_id").isNotNull())


def repeated_passages(
    docs: DataFrame, percent: int = 75, reach: int = 7, min_words: int = 8, bands: int = 3, min_found: int = 12, min_run: int = 50, gap: int = 2, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per span to remove: doc_id, passage, start, length, n_words, component_id, kept_doc_id.

    Paragraphs (see ``Paragraphs``) are linked if their sets of 5-word shingles have 100 * intersection >= ``percent``
    * union. Of each component that more than one document has, the first paragraph of the smallest doc_id stays; the
    others are repeats. Repeats in a row are a run; one of ``min_found`` words or more grows at both ends word by word as far as its text equals
    that of the kept copy, by ``min_run`` words at most, so that a passage need not begin and end at a cut. Runs with
    ``gap`` words or fewer between them are one passage; passages of ``min_run`` words or more are listed. So shorter
    repeats, such as common lines, stay: what is sought is passages of at least ``min_run`` words.

    start and length are UTF-8 bytes of the text; a span reaches to the next word. Null, empty and blank texts have no
    paragraphs. Rows without a doc_id are left alone; rows with equal doc_id and text are one document; rows with equal
    doc_id and different texts lose what other documents have, each in its own text. An empty table gives no rows.

    A band is one minhash, which two paragraphs share with the chance of their Jaccard similarity; ``bands`` of them
    find a pair at 0.75 with chance 1 - 0.25 ** bands. Unrelated passages share no run of five words, so one minhash
    tells enough. Equal paragraphs are one class, known by a hash of their words; classes that meet in a band are
    verified on their full sets, first with the smallest of the band, then those left in different components, in
    blocks. Components are found over classes, never over copies.
    """
    shape = (reach, min_words, bands)
    docs = _keyed(docs, text, doc_id)
    marked = marked_documents(docs, shape, percent, min_found, min_run)
    texts = of_ids(docs, marked.select("doc_id").distinct(), "doc_id").join(marked, ["doc_id", "variant"]).select("doc_id", "marks", "beside", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("passage", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "n_words", "component_id", "kept_doc_id"))])

    def made(batch, data, offsets, spans):
        n = [len(x) for x in spans]
        flat = np.array([y for x in spans for y in x], np.int64).reshape(-1, 6)
        return [pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(flat[:, 0], pa.int32()), *(pa.array(flat[:, k]) for k in range(1, 6))]

    return of_passages(texts, shape, min_run, gap, schema, made).distinct()


def without_repeats(
    docs: DataFrame, percent: int = 75, reach: int = 7, min_words: int = 8, bands: int = 3, min_found: int = 12, min_run: int = 50, gap: int = 2, text: str = "text", doc_id: str = "doc_id", size: str | None = "n_chars",
) -> DataFrame:
    """``docs`` without their repeated passages, same columns; ``size``, if it is a column, counts characters anew.

    A document that is left without a word is dropped if it had one before; others keep their rows, also those with a
    null text or doc_id. Texts without a repeat are not moved.
    """
    shape = (reach, min_words, bands)
    marked = marked_documents(_keyed(docs, text, doc_id), shape, percent, min_found, min_run)
    touched, rest = split_of_ids(docs, marked.select("doc_id").distinct(), doc_id)
    variant, key, of, marks, beside, changed = (fresh(docs, f"__{c}") for c in ("variant", "key", "of", "marks", "beside", "changed"))
    joined = touched.withColumn(variant, F.hash(named(text))).join(marked.toDF(key, of, marks, beside), (named(doc_id) == F.col(key)) & (F.col(variant) == F.col(of)), "left")
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, docs.schema[text], T.StructField(changed, T.BooleanType())])
    columns = [named(f.name) for f in others]

    def made(batch, data, offsets, spans):
        texts = batch.column(batch.num_columns - 1)
        touched = np.array([bool(x) for x in spans])
        new = []
        for k in np.flatnonzero(touched).tolist():
            raw, at, parts = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
            for _, start, length, *_ in spans[k]:
                parts.append(raw[at:start])
                at = start + length
            new.append(b"".join([*parts, raw[at:]]).decode())
        changed = pa.array(touched, pa.bool_())
        return [*batch.columns[:-3], pc.replace_with_mask(texts, changed, pa.array(new, texts.type)), changed]

    cleaned = of_passages(joined.select(*columns, marks, beside, named(text)), shape, min_run, gap, schema, made)
    cleaned = cleaned.where(~F.col(changed) | named(text).rlike(r"[^\x20\x09-\x0D]"))
    if size in docs.columns:
        cleaned = cleaned.withColumn(size, F.when(F.col(changed), F.char_length(named(text)).cast(docs.schema[size].dataType)).otherwise(named(size)))
    own = [named(c) for c in docs.columns]
    return rest.select(*own).unionByName(cleaned.select(*own))
