"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendloom.llm.columns import fresh, named, with_text_columns

#: Fixed shape of the network: chunks of CHUNK windows which overlap by OVERLAP, windows of WIDTH bytes, every STRIDE.
CHUNK, OVERLAP, WIDTH, STRIDE = 512, 64, 8, 2
FILTERS, HIDDEN, EMBED = 32, 12, 6
#: Responses are computed for so many windows at a time, whatever the length of a text.
PART = 1 << 15


class Windows:
    """Where the windows of a block of texts lie, and the chunks that they form.

    Window k of a text covers its bytes from k * STRIDE; every byte lies in a window, and an empty text is one window of
    padding. Windows are numbered through all texts. They are pooled in pieces of OVERLAP windows first, and chunks are
    runs of pieces, so that windows which two chunks share are computed once.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        n = np.maximum(1, -(-(size - WIDTH) // STRIDE) + 1)
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        # bytes two by two; each text has the pairs of its last window, padded with zero bytes, so none reads the next text
        base = STRIDE * (self.bounds[:-1] + (WIDTH // STRIDE - 1) * np.arange(len(n)))
        padded = np.zeros(STRIDE * (self.bounds[-1] + (WIDTH // STRIDE - 1) * len(n)), np.uint8)
        view = memoryview(np.ascontiguousarray(data))
        for at, low, high in zip(base.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            padded[at : at + high - low] = np.frombuffer(view[low:high], np.uint8)
        self.padded = padded
        pairs = padded.view("<u2")
        there = np.zeros(1 << 16, bool)
        there[pairs] = True
        #: the pairs of bytes that occur, and the number among them of each pair of the texts
        self.codes = np.flatnonzero(there)
        number = np.zeros(1 << 16, np.int32)
        number[self.codes] = np.arange(len(self.codes))
        self.pairs = number[pairs]
        pieces = -(-n // OVERLAP)
        self.piece_text = np.repeat(np.arange(len(n)), pieces)
        first = np.cumsum(pieces) - pieces
        self.piece_low = self.bounds[self.piece_text] + OVERLAP * (np.arange(len(self.piece_text)) - first[self.piece_text])
        chunks = np.maximum(1, -(-(n - OVERLAP) // (CHUNK - OVERLAP)))
        self.text = np.repeat(np.arange(len(n)), chunks)
        self.first = np.cumsum(chunks) - chunks
        self.count = chunks
        nth = np.arange(len(self.text)) - self.first[self.text]
        step, whole = (CHUNK - OVERLAP) // OVERLAP, CHUNK // OVERLAP
        self.chunk_low = first[self.text] + step * nth
        self.chunk_high = np.minimum(self.chunk_low + whole, (first + pieces)[self.text])
        self.filled = np.minimum(CHUNK, n[self.text] - (CHUNK - OVERLAP) * nth) / CHUNK

    def pair_of(self, low: int, high: int) -> np.ndarray:
        """The first pair of each of the windows from ``low`` to ``high``."""
        a, b = np.searchsorted(self.bounds, [low, high], side="right") - [1, 0]
        b = max(a + 1, int(np.searchsorted(self.bounds, high, side="left")))
        per = np.diff(np.clip(self.bounds[a : b + 1], low, high))
        return np.arange(low, high) + (WIDTH // STRIDE - 1) * np.repeat(np.arange(a, b), per)

    def responses(self, tables: np.ndarray, low: int, high: int) -> np.ndarray:
        """[window, filter] from ``low`` to ``high``; ``tables`` has a number for each pair that occurs at each place."""
        at = self.pair_of(low, high)
        total = np.take(tables[0], self.pairs[at], axis=0)
        part = np.empty_like(total)
        for k in range(1, len(tables)):
            total += np.take(tables[k], self.pairs[at + k], axis=0, out=part, mode="clip")
        return total

    def piece_maxima(self, tables: np.ndarray) -> np.ndarray:
        """[piece, filter]: the largest response in each piece."""
        out = np.empty((len(self.piece_low), tables.shape[2]), tables.dtype)
        ends = np.append(self.piece_low[1:], self.bounds[-1])
        step = PART // OVERLAP
        for k in range(0, len(out), step):
            low, high = int(self.piece_low[k]), int(ends[min(k + step, len(out)) - 1])
            out[k : k + step] = np.maximum.reduceat(self.responses(tables, low, high), self.piece_low[k : k + step] - low, axis=0)
        return out


class Network:
    """Filters over byte windows, max-pooled in each chunk; chunks combined by max and mean into one probability.

    A filter is a table of one number for each byte at each place of the window (a byte embedding times the kernel),
    so its response is a sum of look-ups; the tables of two neighbouring places are added up beforehand.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)),
            "kernel": r.normal(0, (WIDTH * EMBED) ** -0.5 * 2, (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            # the last row is for how full the chunk is, so that few patterns in a short text differ from few in a long one
            "w1": r.normal(0, FILTERS**-0.5, (FILTERS + 1, HIDDEN)),
            "b1": np.full(HIDDEN, 0.1),
            "w2": r.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN),
            "b2": np.zeros(1),
        }

    def tables(self, codes: np.ndarray, dtype: type) -> np.ndarray:
        """[pair of places, pair of bytes, filter]"""
        one = np.einsum("be,kef->kbf", self.p["embed"], self.p["kernel"])
        return (one[0::2][:, codes & 255] + one[1::2][:, codes >> 8]).astype(dtype)

    def forward(self, w: Windows, dtype: type = np.float32) -> tuple[np.ndarray, dict]:
        """Logit of each text, and what the gradient needs. Memory follows the texts' bytes, not the responses."""
        tables = self.tables(w.codes, dtype)
        pieces = w.piece_maxima(tables)
        spans = np.stack([w.chunk_low, w.chunk_high], axis=1).ravel()
        pooled = np.maximum.reduceat(np.concatenate([pieces, np.full((1, FILTERS), -np.inf, dtype)]), spans, axis=0)[::2].astype(np.float64)
        z = np.concatenate([np.maximum(pooled + self.p["bias"], 0), w.filled[:, None]], axis=1)
        h = np.maximum(z @ self.p["w1"] + self.p["b1"], 0)
        top = np.maximum.reduceat(h, w.first, axis=0)
        doc = np.concatenate([top, np.add.reduceat(h, w.first, axis=0) / w.count[:, None]], axis=1)
        return doc @ self.p["w2"] + self.p["b2"], {"tables": tables, "pieces": pieces, "pooled": pooled, "z": z, "h": h, "doc": doc, "top": top}

    def gradient(self, w: Windows, y: np.ndarray, weight: np.ndarray, dtype: type = np.float32) -> tuple[float, dict]:
        """Loss and its gradient; a maximum passes its gradient to the first window that reaches it."""
        logit, c = self.forward(w, dtype)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum()
        g = {}
        d = weight * (prob - y) / weight.sum()
        g["w2"], g["b2"] = c["doc"].T @ d, np.array([d.sum()])
        d_doc = d[:, None] * self.p["w2"]
        is_top = c["h"] == c["top"][w.text]
        share = np.add.reduceat(is_top.astype(float), w.first, axis=0)
        d_h = is_top / share[w.text] * d_doc[w.text, :HIDDEN] + (d_doc[:, HIDDEN:] / w.count[:, None])[w.text]
        d_h *= c["h"] > 0
        g["w1"], g["b1"] = c["z"].T @ d_h, d_h.sum(0)
        d_z = ((d_h @ self.p["w1"].T) * (c["z"] > 0))[:, :FILTERS]
        g["bias"] = d_z.sum(0)
        # the piece, then the window, that gave each chunk's maximum
        whole = CHUNK // OVERLAP
        near = np.minimum(w.chunk_low[:, None] + np.arange(whole), w.chunk_high[:, None] - 1)
        piece = np.take_along_axis(near, (c["pieces"][near] == c["pooled"][:, None, :]).argmax(axis=1), axis=1)
        used, place = np.unique(piece, return_inverse=True)
        place = place.reshape(piece.shape)
        ends = np.append(w.piece_low[1:], w.bounds[-1])
        at = np.empty(piece.shape, np.int64)  # first pair of that window
        for k in range(0, len(used), PART // OVERLAP):
            own = used[k : k + PART // OVERLAP]
            pair = np.minimum(w.piece_low[own][:, None] + np.arange(OVERLAP), ends[own][:, None] - 1)
            pair = pair + (WIDTH // STRIDE - 1) * w.piece_text[own][:, None]
            response = sum(c["tables"][j][w.pairs[pair + j]] for j in range(len(c["tables"])))
            best = np.take_along_axis(pair, response.argmax(axis=1), axis=1)
            r, f = np.nonzero((place >= k) & (place < k + len(own)))
            at[r, f] = best[place[r, f] - k, f]
        g["embed"], g["kernel"] = np.zeros_like(self.p["embed"]), np.zeros_like(self.p["kernel"])
        for k in range(WIDTH):
            byte = w.padded[STRIDE * at + k].astype(np.int64)
            by_byte = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), d_z.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            g["kernel"][k] = self.p["embed"].T @ by_byte
            g["embed"] += by_byte @ self.p["kernel"][k].T
        return float(loss), g


def fit(texts: list[bytes], labels: np.ndarray, epochs: int, prior: float = 0.5, seed: int = 7, batch: int = 48) -> Network:
    """Trains with Adam; the labels weigh as ``prior``, the share of label 1, says.

    A third of the texts come once more as a short piece of themselves, since short texts are rare in samples.
    """
    net = Network(seed)
    r = np.random.default_rng(seed)
    pieces, whose = [], []
    for k in range(0, len(texts), 3):
        size = int(r.integers(20, 160))
        low = int(r.integers(0, max(1, len(texts[k]) - size)))
        # from one blank to another, as whole texts begin and end with words
        low = texts[k].find(b" ", low) + 1 if low else 0
        piece = texts[k][low : low + size].rsplit(b" ", 1)[0]
        if len(piece) >= 16:
            pieces.append(piece)
            whose.append(k)
    texts, labels = [*texts, *pieces], np.concatenate([labels, labels[np.array(whose, int)]])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    share = labels.mean()
    weights = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    step, total = 0, max(1, epochs * -(-len(texts) // batch))
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for low in range(0, len(order), batch):
            pick = order[low : low + batch]
            own = [texts[k] for k in pick]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in own])])
            _, g = net.gradient(Windows(np.frombuffer(b"".join(own), np.uint8), offsets), labels[pick], weights[pick])
            step += 1
            rate = 0.02 * (1 - step / (total + 1)) + 0.001
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_bytes: int = 24 << 20, epochs: int = 8, text: str = "text", label: str = "quality", doc_id: str = "doc_id") -> Network | None:
    """Fits the network on a bounded sample of labelled rows that are not held out (None without both labels).

    The bounds are parameters: at most ``sample_rows`` rows, half from each label, in order of a hash of the id, and of
    those as many as come to ``sample_bytes``, leaving out rows of over a hundredth of that. Texts in the sample are
    whole; scoring reads all texts whole.
    """
    key = named(doc_id)
    rows = labels.where(named(label).isin(0, 1) & key.isNotNull()).groupBy(key.alias("id")).agg(F.max(named(label)).alias("y"), F.min(named(label)).alias("y0")).where("y = y0").where(~held_out("id"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(11), "id"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    prior = min(0.9, max(0.1, counts.get(1, 0) / max(1, sum(counts.values()))))
    picked = [x for y in (0, 1) for x in rows.where(F.col("y") == y).orderBy("draw", "id").limit(sample_rows // 2).collect()]
    if len({x["y"] for x in picked}) < 2:
        return None
    spark = docs.sparkSession
    few = spark.createDataFrame([(x["id"], float(x["y"]), x["draw"]) for x in picked], T.StructType([T.StructField("key", labels.schema[doc_id].dataType), T.StructField("y", T.DoubleType()), T.StructField("draw", T.LongType())]))
    own = docs.select(key.alias("id"), F.coalesce(named(text), F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes // 100)
    own = own.join(F.broadcast(few), F.col("id") == F.col("key")).groupBy("key").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("draw").alias("draw"))  # at most sample_rows rows
    running = F.sum(F.octet_length("text")).over(Window.orderBy("draw", "key"))
    seen = own.withColumn("running", running).where(F.col("running") <= sample_bytes).select("text", "y").collect()
    y = np.array([x["y"] for x in seen])
    return fit([x["text"].encode() for x in seen], y, epochs, prior) if len(set(y)) == 2 else None


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5, score: str = "score", predicted: str = "predicted", **training) -> DataFrame:
    """Quality of every whole text: the columns of ``docs``, ``score`` (0 to 1) and ``predicted`` (1 if score >=
    ``threshold``, else 0).

    Trained by ``train`` on labelled rows that are not held out; ids, languages and sources are no inputs. Texts are
    read whole in overlapping chunks, a bounded number of windows at a time. A null or empty text is one window of
    padding and has a score like any other; without usable labels of both kinds every score is 0.5. Repeated rows score
    alike; an empty table gives no rows. Columns of ``docs`` with the names of the two added ones are replaced, so give
    other names to keep them.
    """
    net = train(docs, labels, text=text, doc_id=doc_id, **training)
    kept = docs.select(*(named(c) for c in docs.columns if c.lower() not in (score.lower(), predicted.lower())))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def make():
        model = shared.value

        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            if model is None:
                return [np.full(len(offsets) - 1, 0.5)]
            logit, _ = model.forward(Windows(data, offsets))
            return [1 / (1 + np.exp(-np.clip(logit, -30, 30)))]

        return compute

    scored = with_text_columns(kept, text, [T.StructField(score, T.DoubleType())], make, keep=True)
    return scored.select(*(named(c) for c in kept.columns), named(score), (named(score) >= threshold).cast("int").alias(predicted))


def without_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` predicts 1 for, in the same columns, whatever their names."""
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    scored = score_quality(docs, labels, score=score, predicted=predicted, **options)
    return scored.where(named(predicted) == 1).select(*(named(c) for c in docs.columns))
