"""What makes vectors of texts: an interface, and the hashed one that needs no model."""

from __future__ import annotations

from typing import Protocol

import numpy as np

from clausemill.operators import index


class Embedder(Protocol):
    """``id`` names the vectors it makes: vectors of different ids are never compared."""

    id: str
    dims: int

    def embed(self, texts: list[str | None]) -> np.ndarray:
        """One row of ``dims`` numbers a text. Runs on the executors and must pickle."""
        ...


class HashEmbedder:
    """Hashed words and letter trigrams; a null or empty text gives zeros."""

    def __init__(self, dims: int = 256):
        self.dims, self.id = dims, f"hash-{dims}"

    def embed(self, texts: list[str | None]) -> np.ndarray:
        return index.hash_embed(texts, self.dims)


def embed_one(embedder: Embedder, text: str) -> list[float]:
    return embedder.embed([text])[0].tolist()
