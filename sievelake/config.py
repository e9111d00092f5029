"""Settings of the distillation and retrieval pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    min_content_length: int = 500
    ingest_min_length: int = 100
    batch_size: int = 20
    batch_tokens: int = 25_000
    chunk_tokens: int = 500
    overlap_tokens: int = 50
    chars_per_token: int = 4
    recall_k: int = 100
    top_k: int = 10
    boost_weight: float = 0.3
    question_k: int = 50
    boost_cooldown: float = 120.0
    judge_batch: int = 20
    max_content_chars: int = 500_000
    max_output_tokens: int = 64_000
    question_source_chars: int = 32_000

    @property
    def chunk_chars(self) -> int:
        return self.chunk_tokens * self.chars_per_token

    @property
    def overlap_chars(self) -> int:
        return self.overlap_tokens * self.chars_per_token


SETTINGS = Settings()
