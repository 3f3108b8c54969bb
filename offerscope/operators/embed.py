"""Embedding of chunks with a function of the user."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic embedder: signed counts of hashed lower-case words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[(h >> 1) % dim] += 1 - 2 * (h & 1)
        return out

    return embed


def embed_chunks(chunks: DataFrame, fn: Embedder, dim: int, text: str = "text", size: int = 256) -> DataFrame:
    """The chunks with `embedding`, a vector of length one from fn(texts), called for at most `size` texts at once.

    Null texts are embedded as empty ones; a zero vector stays zero; a result of another shape fails the job. No shuffle.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[np.ndarray] = []
            texts = batch.fillna("").tolist()
            for lo in range(0, len(texts), size):
                part = texts[lo : lo + size]
                v = np.asarray(fn(part), np.float64)
                if v.shape != (len(part), dim):
                    raise ValueError(f"embeddings of shape {v.shape}, not {(len(part), dim)}")
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                out.extend((v / np.where(norm > 0, norm, 1)).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return chunks.withColumn("embedding", run(F.col(text)))
