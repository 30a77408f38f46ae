"""Vector expressions: normalisation, hashed bag of words and pluggable embedders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def l2_normalise(vec: Column) -> Column:
    """Unit vector in double precision; a zero vector stays zero."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def with_query_prefix(text: Column) -> Column:
    return F.concat(F.lit(C.QUERY_PREFIX), F.lit(" "), F.coalesce(text, F.lit("")))


def word_bucket(word: Column, dim: int = C.EMBED_DIM) -> Column:
    """md5(word) modulo `dim`, folding the digest as four 32-bit limbs."""
    digest = F.md5(word)
    step = (2**32) % dim
    acc = F.lit(0).cast("long")
    for i in range(4):
        limb = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        acc = (acc * step + limb) % dim
    return acc.cast("int")


def bow_dims(df: DataFrame, keys: list[str], text: str, dim: int = C.EMBED_DIM) -> DataFrame:
    """The keys and `dim`, the hash bucket, of every word longer than two letters, with repeats.

    A distinct word of a batch is hashed once; with `explode` Spark would find and hash all words once more
    to test for rows without any.
    """
    @F.arrow_udf("array<int>")
    def buckets(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        table = [int(hashlib.md5(w.encode()).hexdigest(), 16) % dim for w in words.dictionary.to_pylist()]
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(table, pa.int32()).take(words.indices))

    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z']{3,})"), 1)
    return df.select(*keys, F.explode_outer(buckets(found)).alias("dim")).filter(F.col("dim").isNotNull())


class BowEmbedder:
    """Deterministic default embedder: hashed bag of words, queries carry the instruction prefix.

    The bucket of a word is looked up once per worker and word.
    """

    def __init__(self, dim: int = C.EMBED_DIM):
        self.dim = dim
        self.prefix = C.QUERY_PREFIX
        self._buckets: dict[str, int] = {}

    def __getstate__(self):
        return {"dim": self.dim, "prefix": self.prefix, "_buckets": {}}

    def _bucket(self, word: str) -> int:
        found = self._buckets.get(word)
        if found is None:
            found = int(hashlib.md5(word.encode()).hexdigest(), 16) % self.dim
            self._buckets[word] = found
        return found

    def _dims(self, text: str) -> list[int]:
        return [self._bucket(w) for w in re.findall(r"[a-z']+", text.lower()) if len(w) > 2]

    def encode(self, texts: list, is_query: bool) -> np.ndarray:
        lead = self._dims(self.prefix) if is_query else []
        found = [lead + self._dims(t or "") for t in texts]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = np.fromiter((d for f in found for d in f), dtype="int64", count=len(rows))
        mat = np.bincount(rows * self.dim + flat, minlength=len(found) * self.dim)
        return unit_rows(mat.reshape(len(found), self.dim))


class ModelEmbedder:
    """Embedder around any sentence model; the model loads once per Python worker."""

    def __init__(self, load_model: Callable[[], Callable[[list[str]], np.ndarray]], dim: int):
        self.load_model, self.dim, self.prefix = load_model, dim, C.QUERY_PREFIX
        self._model = None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def encode(self, texts: list, is_query: bool) -> np.ndarray:
        if self._model is None:
            self._model = self.load_model()
        lead = self.prefix if is_query else ""
        return unit_rows(np.asarray(self._model([lead + (t or "") for t in texts])))


def unit_rows(mat: np.ndarray) -> np.ndarray:
    mat = mat.astype("float64")
    norm = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    return mat / np.where(norm == 0, 1.0, norm)


def encoded(encode, texts: list, is_query: bool, rows: int = 512) -> np.ndarray:
    """Vectors of all texts, encoded `rows` at a time, so that an encoder's own arrays stay small."""
    first = encode(texts[:rows], is_query)
    mat = np.empty((len(texts), first.shape[1]), first.dtype)
    mat[:rows] = first
    for at in range(rows, len(texts), rows):
        mat[at:at + rows] = encode(texts[at:at + rows], is_query)
    return mat


def embed_column(embedder, text: Column, is_query: bool) -> Column:
    """Unit vectors as a column (for storing); searches encode inside the blocked product."""

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        mat = encoded(embedder.encode, texts.to_pylist(), is_query)
        offsets = np.arange(len(mat) + 1, dtype="int32") * mat.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(mat.ravel()))

    return encode(text)
