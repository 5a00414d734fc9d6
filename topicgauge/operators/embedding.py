"""The embedding job: text columns to vector columns.

An embedder adds ``vector`` (``ARRAY<DOUBLE>``) and ``norm`` to a table. Three kinds:

* :class:`HashedTerms` counts terms per hash bucket over Arrow batches, hashing a frequent word once per task,
* :class:`PrecomputedVectors` joins a vector table on its keys,
* :class:`ModelVectors` runs a user's model over Arrow batches, loading it once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions import text as X
from topicgauge.functions import vectors as V


#: Terms whose bucket a task remembers.
_KNOWN_WORDS = 1 << 18
#: Bytes of text that are counted at once; a longer text is counted alone.
_PIECE = 1 << 23
_IN_TERM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: Dotted I and the Kelvin sign: no other character beyond ASCII has ASCII letters in lower case.
_LOWER_TO_ASCII = ("\u0130".encode(), "\u212a".encode())


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, df: DataFrame, text: str) -> DataFrame: ...


def embed(df: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """Vectors for the rows with text; :func:`unembeddable` lists the others."""
    return embedder.embed(df.filter(~X.is_blank(F.col(text))), text)


def embed_facts(facts: DataFrame, embedder: Embedder) -> DataFrame:
    """:func:`embed` for chunk rows with their text facts; who reads the texts in batches counts their words as well."""
    if not isinstance(embedder, HashedTerms):
        return embed(facts, embedder)
    return embedder.embed(facts.filter(~X.is_blank(F.col("text"))), "text", "word_count")


def unembeddable(df: DataFrame, text: str = "text") -> DataFrame:
    blank = F.col(text).isNull() | X.is_blank(F.col(text))
    return df.filter(blank).withColumn("reason", F.lit("blank text"))


def without_vector(df: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows that a vector table has no row for."""
    if not isinstance(embedder, PrecomputedVectors):
        return df.filter(F.lit(False)).withColumn("reason", F.lit("no vector"))
    known = embedder.table.select(*embedder.keys)
    return df.join(known, list(embedder.keys), "left_anti").withColumn("reason", F.lit("no vector"))


def with_metadata(df: DataFrame, embedder: Embedder) -> DataFrame:
    return df.withColumns({"model_name": F.lit(embedder.name), "embedding_dim": F.size("vector")})


@dataclass(frozen=True)
class HashedTerms:
    """Term counts over ``dim`` hash buckets, kept as whole numbers; the norm sits beside them."""

    dim: int = 64

    @property
    def name(self) -> str:
        return f"hashed-terms-{self.dim}"

    def embed(self, df: DataFrame, text: str, words: str | None = None) -> DataFrame:
        """Terms are the ``[a-z0-9]+`` of the lower-cased text; a bucket is the first 32 bits of a term's MD5, modulo ``dim``.

        With ``words`` that column gets the number of words, which is counted on the way.
        """
        dim, most = self.dim, _KNOWN_WORDS

        @F.arrow_udf("struct<vector array<double>, norm double, words int>")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            @lru_cache(maxsize=most)
            def bucket(word: bytes) -> int:
                return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big") % dim

            for texts in batches:
                missing, counts, numbers = texts.is_null(), [np.zeros(0)], []
                for piece in pieces(texts):
                    counts.append(bucket_counts(lowered(piece), bucket, dim))
                    numbers += word_counts(piece) if words else [0] * len(piece)
                vectors = np.concatenate(counts)
                norms = np.sqrt(np.square(vectors).reshape(-1, dim).sum(axis=1))  # of whole numbers: exact in any order
                ends = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32))
                arrays = [pa.ListArray.from_arrays(ends, pa.array(vectors)), pa.array(norms), pa.array(numbers, pa.int32())]
                yield pa.StructArray.from_arrays(arrays, names=["vector", "norm", "words"], mask=missing)

        found = {"vector": F.col("_terms")["vector"], "norm": F.col("_terms")["norm"]}
        if words:
            found[words] = F.col("_terms")["words"]
        return df.withColumn("_terms", counted(F.col(text))).withColumns(found).drop("_terms")


def _ends(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the buffer of a large binary array, and where the last one ends."""
    if not len(texts):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in runs of rows that hold few bytes, nulls as empty texts, so that long texts are not taken apart together."""
    whole = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    ends, begin = _ends(whole), 0
    while begin < len(whole):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _PIECE, side="right")) - 1)
        yield whole.slice(begin, stop - begin)
        begin = stop


def lowered(texts: pa.Array) -> pa.Array:
    """A large binary array whose ASCII letters are those of the lower-cased texts."""
    ends = _ends(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    if any(special in memoryview(data).tobytes() for special in _LOWER_TO_ASCII):
        return pa.array([raw.decode(errors="replace").lower().encode() for raw in texts.to_pylist()], pa.large_binary())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(_LOWER[data])])


def word_counts(texts: pa.Array) -> list[int]:
    """Words as :func:`topicgauge.functions.text.word_count` counts them: white space is the same set in both."""
    return [len(raw.decode(errors="replace").split()) for raw in texts.to_pylist()]


def bucket_counts(texts: pa.Array, bucket: Callable[[bytes], int], dim: int) -> np.ndarray:
    """Terms per text and bucket, text by text; a term is a run of ``[a-z0-9]`` and is hashed once for all its occurrences."""
    ends = _ends(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends, inside = ends - ends[0], _IN_TERM[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    opens[firsts] = inside[firsts]  # a term does not run on into the next text
    numbers = np.diff(np.searchsorted(np.flatnonzero(opens), ends))
    kept = data[inside]
    borders = np.append(np.flatnonzero(opens[inside]), len(kept)).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(kept)]).dictionary_encode()
    known = np.fromiter(map(bucket, terms.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(terms.dictionary))
    cells = np.repeat(np.arange(len(texts)) * dim, numbers) + known[terms.indices.to_numpy()]
    return np.bincount(cells, minlength=len(texts) * dim).astype(np.float64)


@dataclass(frozen=True)
class PrecomputedVectors:
    """Vectors from a table with ``keys`` and a vector column; ``normalized`` states that all have length 1."""

    table: DataFrame
    keys: tuple[str, ...]
    dim: int
    column: str = "embedding"
    name: str = "precomputed"
    normalized: bool = False

    def embed(self, df: DataFrame, text: str | None = None) -> DataFrame:
        """Rows without a vector are left out; :func:`without_vector` lists them."""
        vectors = self.table.select(*self.keys, as_vector(F.col(self.column)).alias("vector"))
        length = F.lit(1.0) if self.normalized else V.norm(F.col("vector"))
        return df.join(vectors, list(self.keys)).withColumn("norm", length)


@dataclass(frozen=True)
class ModelVectors:
    """Vectors from ``load()(texts) -> 2-D array``, scaled to unit length."""

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int
    name: str = "user-model"
    batch_size: int = 32

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        load, step = self.load, self.batch_size

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                rows: list[np.ndarray] = []
                for i in range(0, len(texts), step):
                    block = np.asarray(model(texts.iloc[i : i + step].tolist()), dtype=np.float64)
                    length = np.linalg.norm(block, axis=1, keepdims=True)
                    rows.extend(np.divide(block, length, out=np.zeros_like(block), where=length > 0))
                yield pd.Series(rows, index=texts.index)

        return df.withColumn("vector", encode(F.col(text))).withColumn("norm", F.lit(1.0))


def as_vector(c: Column) -> Column:
    return c.cast("array<double>")
