"""Trends over mentions: two-window aggregates, momentum, bursts, states, snapshots, alerts, polling tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.catalog import epoch
from newsloom.config import DEFAULT, EngineConfig
from newsloom.functions import trend as k


def hours_since(ts: str | Column, now: str) -> Column:
    return (epoch(F.lit(now)) - epoch(ts)) / 3600.0


def between(start: Column, end: Column, ts: str = "published_at") -> Column:
    return (F.col(ts) >= start) & (F.col(ts) < end)


def bounds(now: str, days: float) -> tuple[Column, Column, Column]:
    """Start of the window before, start of the window, and now."""
    end = F.lit(now).cast("timestamp")
    step = F.expr(f"INTERVAL '{int(days * 86400)}' SECOND")
    return end - step - step, end - step, end


def two_windows(mentions: DataFrame, now: str, days: float, keys: tuple[str, ...] = ("entity_norm", "entity_type"), cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Both windows in one pass, gated by articles and sources; null times drop out."""
    before, start, end = bounds(now, days)
    cur, prev = between(start, end), between(before, start)
    rows = mentions.where(between(before, end))
    return (
        rows.groupBy(*keys)
        .agg(
            F.countDistinct(F.when(cur, F.col("article_id"))).alias("cur"),
            F.countDistinct(F.when(prev, F.col("article_id"))).alias("prev"),
            F.countDistinct(F.when(cur, F.col("source_id"))).alias("sources"),
            F.avg(F.when(cur, F.col("reliability"))).alias("reliability"),
            F.max(F.when(cur, F.col("published_at"))).alias("last_seen_at"),
            F.min("published_at").alias("first_seen_at"),
        )
        .where((F.col("cur") >= cfg.min_articles) & (F.col("sources") >= cfg.min_sources))
    )


def corpus_counts(mentions: DataFrame, now: str, days: float) -> DataFrame:
    """One row: distinct articles of both windows."""
    before, start, end = bounds(now, days)
    return mentions.where(between(before, end)).agg(
        F.countDistinct(F.when(between(start, end), F.col("article_id"))).alias("corpus_cur"),
        F.countDistinct(F.when(between(before, start), F.col("article_id"))).alias("corpus_prev"),
    )


def sparklines(mentions: DataFrame, now: str, days: float, buckets: int, keys: tuple[str, ...] = ("entity_norm", "entity_type")) -> DataFrame:
    """Distinct articles for each of ``buckets`` equal parts of the window, zero-filled."""
    _, start, end = bounds(now, days)
    seconds = days * 86400 / buckets
    slot = F.floor((epoch("published_at") - epoch(start)) / seconds)
    counted = (
        mentions.where(between(start, end))
        .withColumn("bucket", F.greatest(F.lit(0), F.least(F.lit(buckets - 1), slot)).cast("int"))
        .groupBy(*keys, "bucket")
        .agg(F.countDistinct("article_id").alias("n"))
    )
    filled = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    return filled.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("sparkline"))


def rollup(mentions: DataFrame, start: Column, seconds: float, keys: tuple[str, ...]) -> DataFrame:
    """Mergeable counts of each group and time bucket (``bucket``: whole multiples of ``seconds`` from ``start``): one row for each block of article
    and source numbers, with bitmaps of both, the sum and number of reliabilities, and the first and last time.

    Buckets add up: the bitmaps of a span of buckets are the union of theirs, so distinct articles of any span, of all groups together
    too, are counted without the mentions. A row's bitmaps have a fixed size."""
    bucket = F.floor((epoch("published_at") - epoch(start)) / seconds).cast("int").alias("bucket")
    block, place = lambda c: F.bitmap_bucket_number(F.col(c)), lambda c: F.bitmap_bit_position(F.col(c))
    return mentions.groupBy(*keys, bucket, block("article_id").alias("article_block"), block("source_id").alias("source_block")).agg(
        F.bitmap_construct_agg(place("article_id")).alias("articles"),
        F.bitmap_construct_agg(place("source_id")).alias("sources"),
        F.sum("reliability").alias("reliability"),
        F.count("reliability").alias("rated"),
        F.max("published_at").alias("last"),
        F.min("published_at").alias("first"),
    )


def distinct_of(rolled: DataFrame, what: str, by: list[str], name: str) -> DataFrame:
    """How many different articles or sources (``what``: article, source) each group has: ``by`` names its columns."""
    merged = rolled.where(F.col(f"{what}_block").isNotNull()).groupBy(*by, f"{what}_block").agg(F.bitmap_count(F.bitmap_or_agg(f"{what}s")).alias("n"))
    return merged.groupBy(*by).agg(F.sum("n").alias(name))


def windows_of(rolled: DataFrame, buckets: int, keys: tuple[str, ...], cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``two_windows`` out of a roll-up whose buckets 0 to ``buckets`` - 1 are the window before and as many more the window."""
    cur = F.col("bucket") >= buckets
    told = rolled.withColumn("cur_", cur)
    articles = distinct_of(told, "article", [*keys, "cur_"], "n").groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("cur_"), F.col("n"))), F.lit(0)).alias("cur"), F.coalesce(F.max(F.when(~F.col("cur_"), F.col("n"))), F.lit(0)).alias("prev")
    )
    sources = distinct_of(told.where("cur_"), "source", [*keys], "sources")
    rest = told.groupBy(*keys).agg(
        (F.sum(F.when(cur, F.col("reliability"))) / F.nullif(F.sum(F.when(cur, F.col("rated"))), F.lit(0))).alias("reliability"), F.max(F.when(cur, F.col("last"))).alias("last_seen_at"), F.min("first").alias("first_seen_at")
    )
    found = articles.where(F.col("cur") >= cfg.min_articles).join(sources.where(F.col("sources") >= cfg.min_sources), list(keys))
    return found.join(rest, list(keys))


def rolled_counts(rolled: DataFrame, buckets: int) -> DataFrame:
    """``corpus_counts`` out of a roll-up."""
    n = distinct_of(rolled.withColumn("cur_", F.col("bucket") >= buckets), "article", ["cur_"], "n")
    of = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    return n.agg(of(F.col("cur_")).alias("corpus_cur"), of(~F.col("cur_")).alias("corpus_prev"))


def rolled_lines(rolled: DataFrame, buckets: int, keys: tuple[str, ...]) -> DataFrame:
    """``sparklines`` out of a roll-up."""
    counted = distinct_of(rolled.where(F.col("bucket") >= buckets), "article", [*keys, "bucket"], "n")
    filled = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("bucket") - buckets).alias("bucket"), "n"))).alias("m"))
    return filled.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("sparkline"))


def entity_trends(mentions: DataFrame, now: str, days: float, buckets: int = 10, limit: int | None = 50, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Gate, corpus baseline, momentum, novelty, diversity, score, sparkline, burst and state; highest score first."""
    from newsloom.operators.entities import _cut

    keys = ("entity_norm", "entity_type")
    before, _, end = bounds(now, days)
    rolled = _cut(rollup(mentions.where(between(before, end)), before, days * 86400 / buckets, keys))  # the only pass over the mentions
    agg = windows_of(rolled, buckets, keys, cfg).crossJoin(F.broadcast(rolled_counts(rolled, buckets)))  # one row
    c = {n: F.col(n) for n in ("cur", "prev", "sources", "reliability", "corpus_cur", "corpus_prev")}
    rel = k.relative_momentum(c["cur"], c["prev"], c["corpus_cur"], c["corpus_prev"])
    out = (
        agg.withColumn("momentum", k.momentum(c["cur"], c["prev"]))
        .withColumn("rel_momentum", rel)
        .withColumn("novelty", k.novelty(hours_since("first_seen_at", now), cfg))
        .withColumn("recency", k.novelty(hours_since("last_seen_at", now), cfg))
        .withColumn("diversity", k.source_diversity(c["sources"], c["cur"]))
        .withColumn("score", F.round(k.trend_score(c["cur"], c["sources"], c["reliability"], F.col("recency"), F.col("rel_momentum"), cfg), 4))
    )
    if limit is not None:
        out = out.orderBy(F.desc("score"), F.desc("novelty"), *keys).limit(limit)
    out = out.join(rolled_lines(rolled, buckets, keys), list(keys), "left")
    out = out.withColumn("burst", k.window_burst(F.col("sparkline")))
    return out.withColumn("state", k.trend_state(c["cur"], c["prev"], F.col("rel_momentum"), F.col("burst"), cfg))


def rising(trends: DataFrame, limit: int = 20) -> DataFrame:
    """Breaking before developing, then by score."""
    rank = F.when(F.col("state") == "breaking", 0).otherwise(1)
    return trends.where(F.col("state").isin("breaking", "developing")).orderBy(rank, F.desc("score"), "entity_norm", "entity_type").limit(limit)


def snapshots(events: DataFrame, subject: str, ts: str, source: str, bucket_hours: int = 1, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """A row for each subject and closed bucket with any event: counts, cumulative counts, velocities against the
    buckets exactly 1, 6 and 24 back (null if there was none), acceleration, and the burst against up to 24
    rows before."""
    seconds = bucket_hours * 3600
    counted = (
        events.groupBy(F.col(subject).alias("subject"), (F.floor(epoch(ts) / seconds) * seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources"))
        .withColumn("bucket", F.col("bucket").cast("long"))
    )
    by = Window.partitionBy("subject").orderBy("bucket")
    back = lambda h: F.sum("n").over(by.rangeBetween(-h * seconds, -h * seconds))  # noqa: E731  a range of one bucket
    base = F.collect_list("n").over(by.rowsBetween(-cfg.baseline_buckets, -1))
    out = counted.select(
        "*",
        F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        *((F.col("n") - back(h)).cast("double").alias(f"velocity_{h}h") for h in (1, 6, 24)),
        k.trailing_burst(F.col("n"), base).alias("burst"),
    )
    before = F.max("velocity_1h").over(by.rangeBetween(-seconds, -seconds))
    return out.withColumn("acceleration", F.col("velocity_1h") - before).withColumn("signal", F.col("burst") >= cfg.burst_signal)


def capped_alerts(candidates: DataFrame, user: str, day: str, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` alerts a user and day, one for each dedupe key."""
    once = candidates.dropDuplicates([user, day, "dedupe_key"])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(user, day).orderBy(*order))).where(F.col("rank") <= cap)


def polling_tier(sources: DataFrame) -> DataFrame:
    """Tiers from a source's counts (``n_24h``, ``n_7d``) with its dwell: a tier is kept for 15 minutes unless it
    becomes or leaves hibernation; sources younger than a day are normal."""
    wanted = F.when(F.col("n_7d") == 0, "hibernate").when(F.col("n_24h") >= 20, "hot").when(F.col("n_24h") >= 3, "normal").otherwise("cold")
    held = (F.col("minutes_in_tier") < 15) & (wanted != "hibernate") & (F.col("tier") != "hibernate")
    return sources.withColumn("wanted", wanted).withColumn("next_tier", F.when(F.col("age_hours") < 24, "normal").when(held, F.col("tier")).otherwise(wanted))


def source_health(fetches: DataFrame, source: str, ok: Column) -> DataFrame:
    """Success rates and their colour: red below 0.70, yellow below 0.85; under five fetches nothing is said."""
    out = fetches.groupBy(F.col(source).alias("source_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"))
    rate = F.col("good") / F.col("n")
    colour = F.when(F.col("n") < 5, "unknown").when(rate < 0.70, "red").when(rate < 0.85, "yellow").otherwise("green")
    return out.withColumn("rate", rate).withColumn("health", colour)


def grouped_mentions(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions under the ``subject`` that the aliases (entity_norm, canonical) lead to, else under their own name."""
    return mentions.join(aliases, "entity_norm", "left").withColumn("subject", F.coalesce("canonical", "entity_norm")).drop("canonical")


def newest_articles(mentions: DataFrame, now: str, days: float, keys: tuple[str, ...], most: int = 50) -> DataFrame:
    """The newest articles of each group within the window, each once however many variants it names."""
    _, start, end = bounds(now, days)
    a = mentions.where(between(start, end)).select(*keys, "article_id", "published_at", "source_id").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("published_at"), "article_id", "source_id"))
    return a.withColumn("rank", rank).where(F.col("rank") <= most)


def source_shares(mentions: DataFrame, now: str, days: float, keys: tuple[str, ...]) -> DataFrame:
    """How many articles of each group every source has within the window."""
    _, start, end = bounds(now, days)
    return mentions.where(between(start, end)).groupBy(*keys, "source_id").agg(F.countDistinct("article_id").alias("articles"))


def variants(mentions: DataFrame, now: str, days: float, keys: tuple[str, ...], surface: str) -> DataFrame:
    """The names that make up each group, with their most frequent spelling (the least one of equals) and their articles."""
    _, start, end = bounds(now, days)
    m = mentions.where(between(start, end))
    spelt = m.groupBy(*keys, "entity_norm", F.col(surface).alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    mode = spelt.groupBy(*keys, "entity_norm").agg(F.min_by("surface", F.struct((-F.col("n")).alias("n"), F.col("surface"))).alias("surface"))
    return m.groupBy(*keys, "entity_norm").agg(F.countDistinct("article_id").alias("articles")).join(mode, [*keys, "entity_norm"])


def retained(snapshots: DataFrame, now: str, days: int = 180, bucket: str = "bucket") -> DataFrame:
    """Snapshots whose bucket starts within the days that are kept."""
    return snapshots.where(F.col(bucket) >= epoch(F.lit(now)) - days * 86400)


def followed(subscriptions: DataFrame, trends: DataFrame, most: int = 200) -> DataFrame:
    """A user's live subscriptions (user_id, cluster_key, subscribed_at, ended), newest first, with the trend metrics of their
    clusters; those that have none are quiet."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("subscribed_at"), "cluster_key"))
    live = subscriptions.where("not ended").withColumn("rank", rank).where(F.col("rank") <= most).drop("ended")
    j = live.join(trends.select("cluster_key", "cur", "rel_momentum", "state"), "cluster_key", "left")
    return j.withColumn("state", F.coalesce("state", F.lit("quiet"))).withColumn("cur", F.coalesce("cur", F.lit(0)))
