"""Fixed values of ranking and delivery; passed as literals, so that Catalyst folds them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ranking:
    k1: float = 1.2
    title: tuple[float, float] = (4.0, 0.45)  # weight, length normalisation
    head: tuple[float, float] = (2.0, 0.75)
    body: tuple[float, float] = (1.0, 0.75)
    rrf_k: int = 60
    lane_depth: int = 50
    rare_depth: int = 30
    entity_depth: int = 15
    rare_df: int = 15
    pin_df: int = 25
    position_cap: int = 2000
    navigational: dict = field(default_factory=lambda: {"title": 1.2, "bm25": 1.0, "coverage": 1.0, "proximity": 0.8, "graph": 0.5})
    topical: dict = field(default_factory=lambda: {"title": 0.4, "bm25": 1.2, "coverage": 1.5, "proximity": 1.0, "graph": 0.5})
    constant: dict = field(default_factory=lambda: {"tsmatch": 0.9, "rare": 1.1, "semantic": 1.0, "entity": 1.0, "time": 2.2, "title_recency": 1.6})
    navigational_cover: float = 0.3
    pin_cover: float = 0.45
    pin_unique_cover: float = 0.25
    catalogue: float = 0.45
    archived: float = 0.45
    sibling: float = 0.95
    recency_days: int = 60
    gate_low: float = 0.2
    gate_absent: float = 0.35
    gate_cover: float = 0.6
    gate_rescue_absent: float = 0.5
    clarify_band: float = 0.88
    clarify_floor: float = 0.42


RANKING = Ranking()
