"""Settings of ingestion, retrieval, generation and evaluation."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Other environment names of a setting. Fixed values.
ALIASES = {"dense_top_k": ("DENSE_TOP_K", "DENSE_TOP_N"), "bm25_top_k": ("BM25_TOP_K", "BM25_TOP_N"), "rrf_top_k": ("RRF_TOP_K", "RRF_TOP_N"), "rerank_top_k": ("RERANK_TOP_K", "RERANK_TOP_N")}


@dataclass(frozen=True)
class Settings:
    parent_target_tokens: int = 1024
    parent_max_tokens: int = 1200
    child_target_tokens: int = 256
    child_overlap_tokens: int = 48
    dense_top_k: int = 20
    bm25_top_k: int = 20
    rrf_k: int = 60
    rrf_top_k: int = 30
    rerank_top_k: int = 10
    metadata_min_confidence: float = 0.8
    parents_per_document: int = 3
    neighbour_window: int = 1
    context_tokens: int = 6000
    reserved_answer_tokens: int = 1024
    max_context_tokens: int = 8192
    require_citation: bool = True
    parameter_budget: int = 4_000_000_000

    def __post_init__(self) -> None:
        if not 0 <= self.child_overlap_tokens < self.child_target_tokens:
            raise ValueError("the overlap must be smaller than the window")
        if self.rrf_k <= 0:
            raise ValueError("rrf_k must be positive")

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Settings:
        """Settings with values from environment variables (upper-case names or aliases; an empty value counts as unset)."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            for name in (f.name.upper(), *ALIASES.get(f.name, ())):
                if env.get(name):
                    kind = type(f.default)
                    found[f.name] = env[name].lower() in ("1", "true", "yes") if kind is bool else kind(env[name])
                    break
        return cls(**found)


def within_parameter_budget(counts: dict[str, int], packed: frozenset[str] = frozenset(), budget: int = Settings.parameter_budget) -> bool:
    """Whether all models together have fewer parameters than the budget; packed 4-bit tensors hold two in a byte."""
    return sum(2 * n if name in packed else n for name, n in counts.items()) < budget
