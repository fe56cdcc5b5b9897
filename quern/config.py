"""Fixed thresholds and sizes of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    channel_k: int = 20
    final_k: int = 20
    rrf_constant: int = 60
    rrf_window: int = 50
    rerank_limit: int = 50
    rerank_n: int = 5
    rounds: int = 2
    rerank_top1: float = 0.60
    rerank_top3: float = 0.55
    min_candidates: int = 3
    min_documents: int = 2
    min_versions: int = 2
    max_sub_queries: int = 3
    gate_length: int = 18
    min_benefit: float = 0.80
    sub_query_quota: int = 1
    fact_confidence: float = 0.75
    context_tokens: int = 6000
    context_chunks: int = 8
    expansions: int = 2
    clarify_confidence: float = 0.75
    refuse_confidence: float = 0.80
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


DEFAULTS = Config()
