"""Providers for the model calls, and stand-ins that need no model."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from functools import lru_cache


class ChatEndpoint:
    """Generator over an OpenAI-compatible chat endpoint; only addresses travel to the workers."""

    def __init__(self, base: str = "", model: str = "", key: str = "", max_tokens: int = 4096, timeout: float = 600) -> None:
        self.base = base or os.environ.get("RUBRICA_API_BASE", "http://localhost:8000/v1")
        self.model = model or os.environ.get("RUBRICA_MODEL", "default")
        self.key = key or os.environ.get("RUBRICA_API_KEY", "none")
        self.max_tokens, self.timeout = max_tokens, timeout

    def __call__(self, prompt: str, temperature: float, top_p: float) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "top_p": top_p, "max_tokens": self.max_tokens}
        ask = urllib.request.Request(f"{self.base}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"]


@lru_cache(maxsize=2)
def _sentence_model(name: str):
    from sentence_transformers import SentenceTransformer  # optional

    return SentenceTransformer(name)


class SentenceEmbedder:
    """Embedder over a sentence model, loaded once per worker."""

    def __init__(self, name: str = "all-MiniLM-L6-v2") -> None:
        self.name = name

    def __call__(self, texts: list, batch: int) -> list:
        return _sentence_model(self.name).encode(texts, normalize_embeddings=True, batch_size=batch)


class HashedTerms:
    """Embedder without a model: unit vectors of hashed term counts."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: list, batch: int) -> list:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in t.lower().split():
                v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % self.dimensions] += 1
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


class FixedReplies:
    """Generator without a model: the same reply to the same prompt, chosen by its hash."""

    def __init__(self, replies: tuple) -> None:
        self.replies = replies

    def __call__(self, prompt: str, temperature: float, top_p: float) -> str:
        h = hashlib.blake2b(f"{prompt}{temperature:.3f}".encode(), digest_size=4).digest()
        return self.replies[int.from_bytes(h, "big") % len(self.replies)]
