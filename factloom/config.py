"""Thresholds and sizes of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """The defaults that results depend on."""

    default_owner: str = "demo"
    max_chunk_characters: int = 8000
    min_extraction_characters: int = 200
    similarity_threshold: float = 0.78
    adjudication_similarity: float = 0.82
    adjudication_batch: int = 20
    max_adjudication_pairs: int = 400
    match_confidence_threshold: float = 0.6
    compatibility_threshold: float = 0.75
    match_top_k: int = 20
    value_tolerance: float = 0.01
    percentage_tolerance: float = 0.01
    embedding_batch_size: int = 64
    embedding_batch_tokens: int = 40_000
    embedding_tokens_per_minute: int = 200_000
    lease_seconds: int = 120


DEFAULTS = Config()
