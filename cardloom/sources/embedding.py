"""Embedding of texts by a callable that is given to every partition."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def hash_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """Unit vectors of hashed tokens: the same text gives the same vector everywhere."""
    out = np.zeros((len(texts), width), dtype=np.float32)
    for i, text in enumerate(texts):
        for token in (text or "").lower().split():
            digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
            out[i, digest[0] % width] += 1 if digest[1] % 2 else -1
        if not out[i].any():
            out[i, 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embedded(rows: DataFrame, id_column: str, text_column: str, embedder: Callable[[list[str]], np.ndarray] = hash_embedder) -> DataFrame:
    """(id, embedding) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch[id_column], "embedding": list(embedder(batch[text_column].tolist()))})

    return rows.select(id_column, text_column).mapInPandas(run, "id long, embedding array<float>")
