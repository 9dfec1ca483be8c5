"""Token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.llm.columns import with_text_columns
from spendloom.llm.transducer import Tokenizer

_compiled: dict[str, Tokenizer] = {}


def compiled(spec: str) -> Tokenizer:
    """The tokenizer of a vocabulary file's text; one is kept in each worker process with what it has compiled."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Tokenizer(spec)
    return _compiled[key]


@functools.lru_cache(maxsize=2)
def read_spec(path: str) -> str:
    """The text of a vocabulary file on the driver (a few MB whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text, and whether they are over ``limit``.

    ``vocabulary`` is the path of a byte-level BPE file on the driver; executors get its text by broadcast.
    Columns of ``docs`` other than ``text`` are kept; n_bytes long, n_tokens long, over_limit boolean are added (and
    replace columns of those names). A null or empty text has 0 of both; repeated rows are counted each; an empty
    table gives no rows. Special strings inside a text count as one token, as the library's default has it.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    added = ("n_bytes", "n_tokens", "over_limit")

    def make():
        tokenizer = compiled(spec.value)

        def compute(data: np.ndarray, offsets: np.ndarray) -> list:
            n = tokenizer.count(data, offsets)
            return [np.diff(offsets), n, n > limit]

        return compute

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    return with_text_columns(kept, text, fields, make)
