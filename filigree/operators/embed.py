"""Embedding of text columns by an injected callable."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], Iterable[Iterable[float]]]


def fake_embedder(dim: int) -> Embedder:
    """Deterministic unit vectors: the text's SHA-256 seeds a normal draw."""

    def embed(texts: list[str]):
        import numpy as np

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dim)
            out[i] = v / np.linalg.norm(v)
        return out

    return embed


def http_embedder(url: str, model: str, *, timeout: float = 120.0, tries: int = 3) -> Embedder:
    """Unit vectors from a service that takes {"model", "input"} and gives {"embeddings"}.

    A failed call is repeated after a pause; the last failure is raised.
    """

    def embed(texts: list[str]):
        import json
        import time
        import urllib.request

        import numpy as np

        body = json.dumps({"model": model, "input": texts}).encode()
        for n in range(tries):
            try:
                request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    found = np.asarray(json.load(answer)["embeddings"], np.float32)
                break
            except OSError:
                if n + 1 == tries:
                    raise
                time.sleep(2.0**n)
        size = np.linalg.norm(found, axis=1, keepdims=True)
        return found / np.where(size == 0, 1, size)

    return embed


def embed_column(df: DataFrame, text_col: str, embedder: Embedder, *, batch: int = 16, out: str = "vector") -> DataFrame:
    """``df`` with a vector for each text; null for a null text.

    The callable is called in the workers on at most ``batch`` texts at a time.
    """
    from pyspark.sql import types as T

    at = df.columns.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in batches:
            texts = rows.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for a in range(0, len(known), batch):
                part = known[a : a + batch]
                for i, v in zip(part, np.asarray(embedder([texts[i] for i in part]), np.float32), strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*rows.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
