"""One frozen set of parameters, handed to every operator; no operator reads a clock or a global."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    """Fixed values that results depend on, with their defaults."""

    # trends
    min_articles: int = 2
    min_sources: int = 2
    breaking_min_articles: int = 3
    rel_breaking: float = 0.25
    burst_breaking: float = 1.0
    burst_developing: float = 0.3
    burst_fading: float = -0.5
    burst_signal: float = 2.0
    baseline_buckets: int = 24
    novelty_half_life_hours: float = 12.0
    volume_ceiling: int = 50
    diversity_ceiling: int = 15
    new_momentum: float = 0.5
    score_weights: tuple[float, ...] = (0.40, 0.25, 0.20, 0.10, 0.05)
    # retrieval
    top_k: int = 10
    candidate_pool: int = 30
    min_semantic_score: float = 0.50
    min_text_score: float = 0.10
    rrf_k: int = 60
    ner_df_threshold: int = 30
    ner_fetch_limit: int = 100
    ner_cap: int = 30
    parent_articles: int = 3
    parent_siblings: int = 5
    # clusters
    semantic_threshold: float = 0.85
    title_threshold: float = 0.40
    cluster_window_hours: int = 72
    weekly_threshold: float = 0.75
    weekly_top: int = 8
    generic_anchor_max: int = 15
    # chunks
    target_tokens: int = 256
    max_tokens: int = 384
    min_tokens: int = 100
    overlap_tokens: int = 64
    token_coefficient: float = 1.3
    # curation
    buffer_days: int = 7
    max_edit_ratio: float = 0.05
    alert_cap: int = 20

    def but(self, **changes) -> EngineConfig:
        return replace(self, **changes)


DEFAULT = EngineConfig()
