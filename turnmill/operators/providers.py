"""Calls to outside models, batch by batch, with retries; offline stand-ins by default.

A provider is any function of a list of texts; it runs in the tasks and must be picklable.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]

#: Seconds to wait before each new try after a refusal for load.
WAITS = (5.0, 10.0, 20.0)


class Busy(Exception):
    """Raised by a provider that refuses for load; worth another try."""


def hashed_vectors(width: int = 64) -> Provider:
    """A stand-in: words hashed to signed places, scaled to length one. The same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % width] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype("float32").tolist()

    return embed


def called(provider: Provider, texts: list[str], waits: tuple[float, ...] = WAITS) -> list[list[float]]:
    """One call, tried again after each wait while the provider is busy; other errors pass on."""
    for wait in (*waits, None):
        try:
            out = provider(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} results for {len(texts)} texts")
            return out
        except Busy:
            if wait is None:
                raise
            time.sleep(wait)
    raise AssertionError("unreachable")


def embedded(df: DataFrame, text: str, provider: Provider, batch: int = 100, waits: tuple[float, ...] = WAITS, into: str = "embedding") -> DataFrame:
    """``df`` with ``into``, the provider's vector of each text (null for null and blank texts)."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float] | None] = [None] * len(pdf)
            todo = [i for i, x in enumerate(pdf[text]) if isinstance(x, str) and x.strip()]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                for i, v in zip(part, called(provider, [pdf[text].iloc[i] for i in part], waits), strict=True):
                    vectors[i] = v
            yield pdf.assign(**{into: pd.Series(vectors, index=pdf.index, dtype=object)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(into).schema)
    return df.drop(into).mapInPandas(embed, f"{fields}, `{into}` array<float>")


def not_yet(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``done``: what a run that goes on has left to do."""
    return new.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
