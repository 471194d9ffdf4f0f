"""Text to vector, by a model that can be exchanged; the default hashes words and their trigrams."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 64


def hashing_model(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed counts of hashed words and word trigrams, of unit length; blank texts are zero vectors."""
    out = np.zeros((len(texts), dimension), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            for g in {w, *(w[k : k + 3] for k in range(len(w) - 2))}:
                h = zlib.crc32(g.encode("utf-8", "surrogatepass"))
                out[i, h % dimension] += 1 if h & 0x10000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


#: Models of this worker process, by the key of their loader.
_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def model_of(key: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """The model a loader makes: made once in each worker process and kept for its later tasks. One model is held at a time."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = load()
    return _MODELS[key]


def embed(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Column:
    """The vector of each text, in order; ``load`` makes the model, once per worker."""
    from pyspark import cloudpickle

    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest() if load else ""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ledgerlens.functions.embedding import model_of  # the worker's own module, which outlives the task

        model = model_of(key, load) if load else hashing_model
        for s in batches:
            yield pd.Series(list(model(s.tolist())))

    return run(text)
