"""Parameters of retrieval and ingestion (fixed values of the model, as defaults)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Passed explicitly; there is no global state."""

    embedding_dim: int = 1024
    embedding_model: str = "fake"
    threshold_low: float = 0.45
    threshold_high: float = 0.55
    spread_min: float = 0.15
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    mmr_lambda: float = 0.7
    max_tokens_per_chunk: int = 512
    chunk_overlap_tokens: int = 64
    max_pdf_bytes: int = 25 * 1024 * 1024
    list_depth: int = 50
    rrf_k: int = 60
    rerank_window: int = 40
    max_expansions: int = 3
    heading_ratio: float = 1.3
    bold_ratio: float = 1.31
    low_text_chars: int = 50
    default_body_size: float = 11.0
    tokenizer_version: str = "v3"


DEFAULTS = Settings()
