"""Every threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Outlets whose corroboration counts double.
MAJOR_OUTLETS = (
    "Reuters",
    "Financial Times",
    "Wall Street Journal",
    "CNN",
    "CBS",
    "Fox News",
    "New York Post",
    "Just The News",
)

# Stale phrasings that keep an item from being selected.
BLOCKED_PHRASES = (
    "former president trump",
    "former us president trump",
    "former u.s. president trump",
    "former president donald trump",
    "former us president donald trump",
    "former u.s. president donald trump",
)

# Sentences that mark a subscription notice instead of an article.
PAYWALL_PHRASES = (
    "subscribe to unlock this article",
    "try unlimited access",
    "complete digital access to quality",
)


@dataclass(frozen=True)
class Params:
    # arrival
    max_publish_age_hours: float = 3
    url_ttl_seconds: int = 864_000
    #: Texts are stored and compared whole unless a limit is given.
    compare_chars: int | None = None
    stored_chars: int | None = None
    # similarity
    duplicate_floor: float = 0.8
    related_floor: float = 0.6
    history_hours: float = 72
    event_hours: float = 240
    posted_floor: float = 0.70
    posted_hours: float = 240
    retention_days: float = 10
    event_candidates: int = 5
    points_per_candidate: int = 4
    # identity
    hub_events: int = 2
    pair_events_max: int = 1
    core_doc_freq: int = 2
    overlap_floor: float = 0.15
    core_update_weight: float = 1.5
    corroboration_weight: float = 1.0
    restatement_weight: float = 0.2
    major_outlets: tuple[str, ...] = MAJOR_OUTLETS
    major_weight: float = 2.0
    # language and text
    cjk_max: float = 0.05
    cjk_meta_max: float = 0.2
    min_language_chars: int = 20
    language_chars: int | None = None
    min_text_chars: int = 200
    paywall_phrases: tuple[str, ...] = PAYWALL_PHRASES
    blocked_phrases: tuple[str, ...] = BLOCKED_PHRASES
    # selection
    score_floor: float = 5.0
    pool_score_floor: float = 5.0
    pool_hours: float = 12
    weekday_floor: float = 6.0
    weekend_floor: float = 5.0
    top_tier_score: float = 7.0
    fresh_hours: float = 4
    batch_min: int = 3
    batch_max: int = 10
    trending_limit: int = 15
    alert_cooldown_seconds: int = 21_600
    calendar_zone: str = "America/New_York"
    # physical: vectors per block of a similarity join
    block_rows: int = 2048
