"""Defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    max_tokens: int = 900
    min_tokens: int = 60
    overlap_tokens: int = 100
    router_min_chars: int = 60
    dense_k: int = 40
    sparse_k: int = 40
    rrf_k: int = 60
    fused_n: int = 20
    top_k: int = 6
    first_page_factor: float = 0.85
    identifier_factor: float = 1.5
    identifier_docs: int = 40
    hard_filter_docs: int = 3
    identifier_extra: int = 10
    strike_coverage: float = 0.55
    strike_band: float = 0.45
    calls_per_minute: int = 60
    calls_per_day: int = 1000
    #: Query rows that are sent to every task at once; more are worked off in blocks.
    query_block: int = 4096


DEFAULT = Config()
