"""Vector columns and the embedder contract."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from dossier import constants as K

#: Texts embedded at a time, and words a worker remembers, so that a worker's memory does not grow with its input.
EMBED_ROWS = 256
KNOWN_WORDS = 100_000


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision, for a handful of pairs per row.

    Searches over many pairs use the matrix form in ``operators.similarity``.
    """
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


class Embedder(Protocol):
    """Anything that turns texts into unit vectors; sent to the executors by pickling."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Word counts hashed into ``dim`` buckets, scaled to unit length. Needs no model."""

    def __init__(self, dim: int = K.EMBED_DIM):
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = self._bucket.get(word)
        if found is None:
            if len(self._bucket) >= KNOWN_WORDS:
                self._bucket.clear()
            found = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % self.dim
            self._bucket[word] = found
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            hits = [self.bucket(w) for w in text.lower().split()]
            out[row] = np.bincount(hits, minlength=self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def embed(text: Column, embedder: Embedder) -> Column:
    """Embedding of the first 8000 characters; null for blank text or a failed batch row.

    A batch is embedded and handed back in parts, so that vectors of a part alone are held.
    """

    def run(texts: pd.Series) -> pd.Series:
        ready = texts.map(lambda t: t is not None and t.strip() != "")
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if ready.any():
            try:
                vectors = list(embedder.embed(list(texts[ready])))
            except Exception:
                vectors = [_embed_one(embedder, t) for t in texts[ready]]
            out[ready] = pd.Series(vectors, index=texts[ready].index, dtype=object)
        return out

    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for start in range(0, len(texts), EMBED_ROWS):
                yield run(texts.iloc[start:start + EMBED_ROWS])

    return F.pandas_udf(parts, S.ArrayType(S.FloatType()))(F.substring(text, 1, K.EMBED_CHARS))


def _embed_one(embedder: Embedder, text: str) -> np.ndarray | None:
    try:
        return embedder.embed([text])[0]
    except Exception:
        return None
