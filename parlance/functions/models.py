"""Pluggable model calls: one embedding function and one text function, both over Arrow batches.

The defaults are deterministic local stand-ins, so that jobs run without a model service.  They
make no claim to the quality, or the scores, of a trained model.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.tokens import Tokens, cuts, from_lists, give_back, tokenise

EmbedFn = Callable[[list[str]], np.ndarray]
ModelFn = Callable[[list[str]], list[str]]

REQUEST_SIZE = 32

DIMENSIONS = 64
_MAX_CELLS = 100_000  # about 20 MB of a worker


class _Cells(dict):
    """Feature -> dimension, plus DIMENSIONS when the sign is negative.  One per Python worker."""

    def __missing__(self, feature: str) -> int:
        value = int(hashlib.md5(feature.encode()).hexdigest()[:7], 16)
        code = self[feature] = value % (2 * DIMENSIONS)
        return code


_cells = _Cells()


def word_features(texts: list[str]) -> Tokens:
    return tokenise(pa.array(texts, type=pa.string()))


def trigram_features(texts: list[str]) -> Tokens:
    """Character trigrams of the lower-case text with one space around it; close spellings share many."""
    padded = [f" {text.lower()} " for text in texts]
    return from_lists([[p[i:i + 3] for i in range(len(p) - 2)] for p in padded])


def embed_batch(texts: list[str], features: Callable[[list[str]], Tokens] = word_features) -> np.ndarray:
    """Feature hashing: md5 of a feature gives its dimension and sign; rows are scaled to unit length."""
    if len(_cells) > _MAX_CELLS:
        _cells.clear()
    tokens = features(texts)
    coded = tokens.flat.dictionary_encode()
    cells = np.array([_cells[f] for f in coded.dictionary.to_pylist()], dtype=np.int64)
    width = 2 * DIMENSIONS
    places = tokens.owner * width + cells[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(places, minlength=len(texts) * width).reshape(len(texts), width)
    out = (counts[:, :DIMENSIONS] - counts[:, DIMENSIONS:]).astype(float)
    sizes = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, sizes, out=out, where=sizes > 0)


def embed_names(texts: list[str]) -> np.ndarray:
    return embed_batch(texts, trigram_features)


def text_embedding_udf(embed: EmbedFn = embed_batch):
    """``string -> array<double>``; NULL text has no vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.notna().to_numpy()
            result = np.full(len(texts), None, dtype=object)
            rows, asked = np.flatnonzero(known), texts[known]
            for part in cuts(asked.str.len().to_numpy(dtype=np.int64)):
                vectors = np.asarray(embed(asked.iloc[part].tolist()), dtype=float)
                for row, vector in zip(rows[part], vectors, strict=True):
                    result[row] = vector
            yield pd.Series(result)
            give_back()

    return embedding


RESULT_TYPE = T.StructType([
    T.StructField("result", T.StringType()),
    T.StructField("errorMessage", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
])


def safe_call_udf(model: ModelFn, request_size: int = REQUEST_SIZE):
    """``string -> struct(result, errorMessage, seconds)``; a failing text never fails the others.

    Texts go to the model in requests of ``request_size``.  A model may put an exception in the place of an
    answer; if it raises instead, only the texts of that request are tried again, one by one.  ``seconds``
    is the wall time of the call that answered the row, shared among its texts.
    """

    def one(text: str) -> tuple[str | None, str | None, float]:
        start = time.perf_counter()
        try:
            answer, error = outcome(model([text])[0])
        except Exception as problem:  # the error belongs in the row
            answer, error = outcome(problem)
        return answer, error, time.perf_counter() - start

    def outcome(answer: str | Exception) -> tuple[str | None, str | None]:
        if isinstance(answer, Exception):
            return None, str(answer) or type(answer).__name__
        return answer, None

    def request(asked: list[str]) -> list[tuple[str | None, str | None, float]]:
        start = time.perf_counter()
        try:
            answers = model(asked)
            if len(answers) != len(asked):
                raise ValueError("the model must return one answer per text")
        except Exception:
            return [one(t) for t in asked]
        spent = (time.perf_counter() - start) / len(asked)
        return [(*outcome(a), spent) for a in answers]

    @F.pandas_udf(RESULT_TYPE)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = texts.notna().to_numpy()
            rows: list[tuple] = [(None, None, None)] * len(texts)
            asked = texts[known].tolist()
            found = [row for k in range(0, len(asked), request_size) for row in request(asked[k:k + request_size])]
            for position, row in zip(np.flatnonzero(known), found):
                rows[position] = row
            yield pd.DataFrame(rows, columns=RESULT_TYPE.names).astype({"seconds": "float64"})

    return call.asNondeterministic()  # so that no filter on the answer makes a second call
