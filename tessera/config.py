"""Parameters of the retrieval engine, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Fixed values.
    target_tokens: int = 410
    max_tokens: int = 512
    overlap_tokens: int = 41
    k1: float = 1.5
    b: float = 0.75
    channel_limit: int = 20
    expansion_weight: int = 2
    rrf_k: int = 1
    bm25_weight: float = 3.0
    vector_weight: float = 1.0
    prior_weight: float = 0.16
    protect_score: float = 0.97
    protect_slots: int = 5
    min_top_score: float = 0.10
    min_confidence: float = 0.60
    min_coverage: float = 0.25
    time_penalty_below: float = 0.80
    min_alnum: int = 50
    min_usable: float = 0.01
    max_replacement: float = 0.15
    max_duplicate_lines: float = 0.30
    min_table_density: float = 0.60
    min_overlap: float = 0.30
    low_ocr: float = 0.85
    max_limit: int = 10
    schema_version: int = 4
    #: Decimal places at which channel scores are compared, so that sums in another order rank alike; None: as they are.
    rank_digits: int | None = 6
    #: Part of what an index is built with: another value means another index.
    tokenizer_version: str = "signs-runs-bigrams-1"
    encoder_name: str = "hashed-64"
    query_instruction: str = ""


DEFAULT = Config()
