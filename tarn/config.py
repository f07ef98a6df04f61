"""Settings of the evidence engine; values enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Retrieval:
    chunk_size: int = 480
    chunk_overlap: int = 80
    top_k: int = 8
    candidate_pool: int = 40
    rrf_k: int = 60
    adaptive: bool = True
    dim: int = 384


@dataclass(frozen=True)
class Rerank:
    enabled: bool = True
    alpha: float = 0.5
    z_floor: float = -0.5
    min_margin: float = 0.15
    top_n: int = 8


@dataclass(frozen=True)
class Evidence:
    support_threshold: float = 0.30
    max_unanchored_ratio: float = 0.20
    prune_unanchored: bool = True


@dataclass(frozen=True)
class Debate:
    max_rounds: int = 3
    self_consistency: int = 1
    gap_retrieval: bool = True
    max_sentences: int = 3
    relevance_gate: float = 0.70
    covered_gate: float = 0.50


@dataclass(frozen=True)
class Memory:
    working_size: int = 16
    decay_lambda: float = 0.02
    cluster_threshold: float = 0.86
    min_support: int = 2


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    rerank: Rerank = field(default_factory=Rerank)
    evidence: Evidence = field(default_factory=Evidence)
    debate: Debate = field(default_factory=Debate)
    memory: Memory = field(default_factory=Memory)
