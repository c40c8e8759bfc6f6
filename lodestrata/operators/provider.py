"""The edge to remote models: embeddings, chat, optical character recognition. A provider is an object that Arrow batches are sent to."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """What remote models offer. Implementations must be picklable, and calls repeatable, since a lost task repeats them."""

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...

    def chat(self, prompt: str) -> str: ...

    def ocr(self, content: bytes) -> str: ...


class FakeProvider:
    """Deterministic: embeddings seeded by the text, replies by the first rule that matches the prompt, recognised pages by content."""

    def __init__(self, dim: int = 64, rules: tuple[tuple[str, str], ...] = (), pages: dict[bytes, str] | None = None):
        self.dim, self.rules, self.pages = dim, rules, pages or {}

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")).normal(size=self.dim)
            out[i] = v / np.linalg.norm(v)
        return out

    def chat(self, prompt: str) -> str:
        for pattern, reply in self.rules:
            if re.search(pattern, prompt):
                return reply
        if prompt.startswith("Classify"):
            query = prompt.rpartition("Question: ")[2]
            return json.dumps({"intent": "NO_SEARCH" if re.fullmatch(r"\W*(hello|hallo|hola|bonjour|hi)\W*", query, re.I) else "SEARCH", "rewritten_query": query, "expansion_queries": []})
        if prompt.startswith("Score"):
            query = set(re.findall(r"\w+", prompt.partition("Question: ")[2].partition("\n\n")[0].lower()))
            passages = re.split(r"\n\n(?=\[\d+\] )", prompt)[1:]
            share = [len(query & set(re.findall(r"\w+", p.lower()))) / max(1, len(query)) for p in passages]
            return json.dumps({"scores": [{"id": str(i), "score": round(s, 4)} for i, s in enumerate(share)]})
        if prompt.startswith("Does the question"):
            return json.dumps({"action": "DISCLAIMER"})
        if prompt.startswith("For each pair"):
            return json.dumps({m: True for m in re.findall(r"^id: (\d+)$", prompt, re.M)})
        first = re.search(r"^\[1\] (.+?)(?:\.|\n|$)", prompt, re.M)
        return f"{first[1]} [1]." if first else ""

    def ocr(self, content: bytes) -> str:
        return self.pages.get(content, "")


def embed(df: DataFrame, text: str, provider: Provider, out: str = "embedding") -> DataFrame:
    """``df`` with unit vectors of ``text``, one request a batch. Null and empty texts give the zero vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            v = provider.embed_batch([t or "" for t in texts])
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(n > 0, v / np.where(n > 0, n, 1), 0)
            v[[not t for t in texts]] = 0
            yield pd.Series(list(v.astype(np.float32)))

    return df.withColumn(out, run(F.col(text)))


def chat(df: DataFrame, prompt: str, provider: Provider, out: str = "reply") -> DataFrame:
    """``df`` with the model's reply; a call that fails gives null, which every parser reads as its fallback. Null prompts aren't sent."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            replies = []
            for p in prompts:
                try:
                    replies.append(None if p is None else provider.chat(p))
                except Exception:
                    replies.append(None)
            yield pd.Series(replies, dtype=object)

    return df.withColumn(out, run(F.col(prompt)))


def recognise(df: DataFrame, content: str, provider: Provider, out: str = "ocr_text") -> DataFrame:
    """``df`` with the recognised text of scanned content; pages are parted by form feeds."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield pd.Series([None if c is None else provider.ocr(bytes(c)) for c in contents], dtype=object)

    return df.withColumn(out, run(F.col(content)))
