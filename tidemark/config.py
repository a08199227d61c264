"""Settings of the engine.  `now` is always explicit, so that results can be repeated."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    now: str = "2026-11-01T00:00:00Z"
    decay_rate: float = 0.03
    hot: float = 0.3
    warm: float = 0.15
    budget: int = 4000
    query_tokens: int = 10
    top_k: int = 5
    duplicate: float = 0.5
    supersede_from: float = 0.3
    tail_rows: int = 50
    tail_bytes: int = 8192
    cluster: float = 0.4
    repeat: float = 0.4
    same: float = 0.6
    fix_seconds: int = 300
    gate_seconds: int = 600


DEFAULT = EngineConfig()
