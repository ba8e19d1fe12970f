"""Trend kernels over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.config import DEFAULT, EngineConfig


def momentum(cur: Column, prev: Column) -> Column:
    """Growth over the window before; null if there was nothing before, 0 if there is nothing at all."""
    return F.when(prev > 0, (cur - prev) / prev).when(cur > 0, F.lit(None)).otherwise(0.0)


def relative_momentum(cur: Column, prev: Column, corpus_cur: Column, corpus_prev: Column) -> Column:
    """Growth beyond that of the whole corpus; null if there was nothing before."""
    own = cur / F.nullif(prev, F.lit(0))
    corpus = corpus_cur / F.nullif(corpus_prev, F.lit(0))
    return F.when(prev <= 0, F.lit(None)).when((corpus_prev > 0) & (corpus_cur > 0), own / corpus - 1).otherwise(own - 1)


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(xs))


def spread(xs: Column) -> Column:
    """Population standard deviation."""
    m = mean(xs)
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m), lambda a: a / F.size(xs)))


def window_burst(buckets: Column) -> Column:
    """How far the last third of the buckets lies above the rest, in deviations of at least 1; 0 below three."""
    n = F.size(buckets)
    recent = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    head, tail = F.slice(buckets, F.lit(1), F.greatest(n - recent, F.lit(1))), F.slice(buckets, -recent, recent)
    return F.when(n < 3, F.lit(0.0)).otherwise((mean(tail) - mean(head)) / F.greatest(spread(head), F.lit(1.0)))


def trailing_burst(cur: Column, baseline: Column) -> Column:
    """The count against the buckets before it; 0 without any."""
    return F.when(F.size(baseline) < 1, F.lit(0.0)).otherwise((cur - mean(baseline)) / F.greatest(spread(baseline), F.lit(1.0)))


def novelty(age_hours: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.when(age_hours.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / cfg.novelty_half_life_hours))


def source_diversity(sources: Column, articles: Column) -> Column:
    return F.when(articles <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), sources / F.nullif(articles, F.lit(0))))


def trend_score(cur: Column, sources: Column, reliability: Column, recency: Column, rel: Column, cfg: EngineConfig = DEFAULT) -> Column:
    capped = lambda x, top: F.least(F.lit(1.0), F.log1p(F.greatest(x, F.lit(0))) / F.log1p(F.lit(float(top))))
    fresh = F.when(cur > 0, F.lit(cfg.new_momentum)).otherwise(0.0)
    m = F.when(rel.isNull(), fresh).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), rel)))
    parts = (capped(cur, cfg.volume_ceiling), m, capped(sources, cfg.diversity_ceiling), F.least(F.lit(1.0), F.greatest(F.lit(0.0), recency)), F.coalesce(reliability, F.lit(0.5)))
    return sum((F.lit(w) * p for w, p in zip(cfg.score_weights[1:], parts[1:], strict=True)), F.lit(cfg.score_weights[0]) * parts[0])


def trend_state(cur: Column, prev: Column, rel: Column, burst: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return (
        F.when(cur == 0, F.when(prev > 0, "fading").otherwise("stable"))
        .when(cur < cfg.breaking_min_articles, F.when(burst > cfg.burst_developing, "developing").otherwise("stable"))
        .when(burst <= cfg.burst_fading, "fading")
        .when((burst >= cfg.burst_breaking) & (rel.isNull() | (rel >= cfg.rel_breaking)), "breaking")
        .when((burst >= cfg.burst_developing) | F.coalesce(rel > 0, F.lit(False)), "developing")
        .otherwise("stable")
    )


def importance(sources: Column, articles: Column) -> Column:
    """Log scale, about 1 for ten sources and ten articles."""
    part = lambda x: F.log10(F.greatest(x, F.lit(1)) + 1) * 0.5
    raw = (part(sources) + part(articles)) / F.log10(F.lit(11.0))
    return F.when((sources <= 0) & (articles <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def cluster_status(age_hours: Column, articles: Column) -> Column:
    return F.when(age_hours > 720, "archived").when(age_hours > 168, "stale").when(age_hours > 72, "cooling").when(articles >= 2, "active").otherwise("developing")


def freshness(age_hours: Column, half_life: float = 24.0) -> Column:
    """Half after each half-life; 0.5 for an unknown age, 1 for a half-life of none."""
    if half_life <= 0:
        return F.when(age_hours.isNull(), 0.5).otherwise(1.0)
    return F.when(age_hours.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / half_life)))


#: Weights of semantic, text, freshness and reliability, for articles and for cards.
FINAL_WEIGHTS = {"articles": (0.50, 0.25, 0.15, 0.10), "cards": (0.45, 0.35, 0.10, 0.10)}


def final_score(semantic: Column, lexical: Column, fresh: Column, reliability: Column, preset: str = "articles") -> Column:
    a, b, c, d = FINAL_WEIGHTS[preset]
    return semantic * a + lexical * b + fresh * c + reliability * d
