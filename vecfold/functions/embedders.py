"""Embedder plug-ins: an object with ``dim`` and ``embed_batch(items) -> n x dim`` floats."""

from __future__ import annotations

import base64
import json
from typing import Protocol, Sequence

import numpy as np


class Embedder(Protocol):
    dim: int

    def embed_batch(self, items: Sequence[bytes | str]) -> np.ndarray: ...


class CharFold:
    """Deterministic embedder over whole texts.

    Component k is the sum over positions p (from 1) of ``code(p) * ((p * (k + 1)) % 7)``; the
    vector is then brought to unit length.
    """

    def __init__(self, dim: int = 16):
        self.dim = dim

    def embed_batch(self, items):
        out = np.zeros((len(items), self.dim))
        weights = np.outer(np.arange(7), np.arange(1, self.dim + 1)) % 7
        for row, item in enumerate(items):
            text = item.decode("utf-8") if isinstance(item, (bytes, bytearray)) else item
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(float)
            by_residue = np.bincount((np.arange(len(codes)) + 1) % 7, codes, minlength=7)
            out[row] = by_residue @ weights
            size = np.sqrt((out[row] ** 2).sum())
            if size > 1e-10:
                out[row] /= size
        return out


class LoopbackService:
    """In-process stand-in for a remote service: request text in, reply text out."""

    def __init__(self, shape: str, embedder: Embedder | None = None):
        self.shape, self.embedder = shape, embedder or CharFold()

    def __call__(self, request: str) -> str:
        doc = json.loads(request)
        data = doc["image_data"][0]["data"] if self.shape == "content" else doc["images"][0]
        vector = np.asarray(self.embedder.embed_batch([base64.b64decode(data)])[0], "f4")
        values = [float(x) for x in vector]
        if self.shape == "content":
            return json.dumps([{"index": 0, "embedding": [values]}])
        return json.dumps({"embeddings": [values]})
