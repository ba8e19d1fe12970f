"""Ingest: cleaning, deduplication, quality gates, due sources, queues, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.config import DEFAULT, EngineConfig
from newsloom.functions import text as t
from newsloom.functions.pii import redact


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows whose key has a null are all kept."""
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_i", first).where(some_null | (F.col("_i") == 1)).drop("_i")


def deduplicate(articles: DataFrame, order: list[str], history: DataFrame | None = None) -> DataFrame:
    """One article for each canonical URL, then for each source and external id, then for each source and content
    hash; articles whose URL the history has are dropped first."""
    if history is not None:
        articles = articles.join(history.select("canonical_url").distinct(), "canonical_url", "left_anti")
    for keys in (["canonical_url"], ["source", "external_id"], ["source", "content_hash"]):
        articles = keep_first(articles, keys, order)
    return articles


def clean(docs: DataFrame, cfg: EngineConfig = DEFAULT, has_date: Column | None = None) -> DataFrame:
    """The fixed chain of stages: boilerplate, personal data, white space, language, hash, quality. ``docs`` has
    (id, text); paragraphs are lines where the text has no blank ones."""
    d = docs.select("id", F.coalesce("text", F.lit("")).alias("raw"))
    d = d.withColumn("bp", F.when(F.contains("raw", F.lit("\n\n")), t.remove_boilerplate(F.col("raw"))).otherwise(t.remove_boilerplate(F.col("raw"), "\n")))
    d = d.withColumn("r", redact(F.col("bp.text"))).withColumn("clean", F.trim(F.regexp_replace(F.regexp_replace("r.text", r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n")))
    d = d.withColumn("lang", t.language(F.col("clean")))
    score = t.quality(F.length("clean"), F.col("bp.removed"), has_date if has_date is not None else F.lit(False), F.col("lang.confidence"))
    counts = [F.col(f"r.{k}").alias(k) for k in ("email", "iban", "uuid", "ip", "tc", "phone")]
    return d.select("id", F.col("clean").alias("text"), F.col("bp.removed").alias("removed"), F.col("lang.code").alias("lang"), t.content_hash(F.col("clean")).alias("content_hash"), F.round(score, 6).alias("quality"), *counts)


def due(sources: DataFrame, now: str) -> DataFrame:
    """Active sources never crawled, or crawled an interval ago or longer."""
    late = F.col("last_crawled") + F.make_interval(mins=F.col("interval_minutes")) <= F.lit(now).cast("timestamp")
    return sources.where(F.col("active") & (F.col("last_crawled").isNull() | late))


def claim(queue: DataFrame, done: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The oldest items that were not handled yet."""
    return queue.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(most)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], protected: Column | None = None) -> DataFrame:
    """``new`` replaces ``old`` on equal keys, but not rows of ``old`` that are protected. The result is a whole table to
    write beside the old one."""
    o = old.withColumn("_age", F.when(protected, 0).otherwise(2) if protected is not None else F.lit(2))
    n = new.select(*old.columns).withColumn("_age", F.lit(1))
    by = Window.partitionBy(*keys).orderBy("_age")
    return o.unionByName(n).withColumn("_i", F.row_number().over(by)).where("_i = 1").drop("_i", "_age")


#: Article states and where each may go.
TRANSITIONS = {
    "discovered": ("fetched", "failed", "discarded"),
    "fetched": ("cleaned", "failed", "quarantine", "discarded"),
    "failed": ("discovered", "discarded"),
    "quarantine": ("discovered", "fetched", "discarded"),
    "cleaned": ("discarded",),
    "discarded": (),
}


def legal(before: Column, after: Column) -> Column:
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, to in TRANSITIONS.items() for b in to))
    return F.array_contains(pairs, F.concat_ws(">", before, after))


def failures(rows: DataFrame, ok: Column, severe: Column) -> tuple[DataFrame, DataFrame]:
    """Split results into good rows and dead letters with a severity."""
    good = F.coalesce(ok, F.lit(False))
    return rows.where(good), rows.where(~good).withColumn("severity", F.when(severe, "critical").otherwise("warning"))


def resolve_siblings(dead: DataFrame, good: DataFrame, key: str) -> DataFrame:
    """Dead letters, marked resolved where the same key got through."""
    through = good.select(key).distinct().withColumn("resolved", F.lit(True))
    return dead.join(through, key, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


#: What titles and the first 2000 characters of pages that are gone say, and what linked data calls an article.
GONE_TITLE = (r"sayfa\s*bulunamad[ıi]", r"page\s*not\s*found", r"hata\s*404", r"404\s*[-—|:]\s*(?:sayfa|page|hata|error|not)", r"içerik\s*bulunamad[ıi]", r"haber\s*bulunamad[ıi]", r"aradığınız\s*sayfa")
GONE_BODY = (r"aradığınız\s*sayfa.*bulunam", r"this\s*page\s*does\s*not\s*exist", r"sorry.*we\s*can[’']t\s*find")
GONE_HEAD = 2000
LINKED_ARTICLE = r'"@type"\s*:\s*(?:\[[^\]]*)?"(?:[^"]*[#/])?(?:newsarticle|article|reportagenewsarticle|backgroundnewsarticle|opinionnewsarticle|analysisnewsarticle|reviewnewsarticle|blogposting|liveblogposting)"'
LINKED_BODY = r'"articleBody"\s*:\s*"[^"]'


def soft_404(html: Column) -> Column:
    """Whether a page that was found says that it isn't there: by its title, else by its beginning; not if its linked data holds an article's text."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    says = lambda c, patterns, flags: F.rlike(c, F.lit(f"(?{flags})" + "|".join(patterns)))
    gone = says(title, GONE_TITLE, "iU") | says(F.substring(html, 1, GONE_HEAD), GONE_BODY, "iUs")
    linked = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    return F.coalesce(gone & ~(F.rlike(linked, F.lit("(?i)" + LINKED_ARTICLE)) & F.rlike(linked, F.lit(LINKED_BODY))), F.lit(False))


def follow_next(starts: DataFrame, fetched: DataFrame, pages: int = 5) -> DataFrame:
    """The pages that each start leads to by next links: (start, place, url), at most ``pages`` of them, the start's own first. ``starts``
    has a start's URL, ``fetched`` (url, next) each URL once, with the absolute address of the page after it. A chain ends where
    it comes back to itself or to what wasn't fetched; a null or repeated start gives nothing or one chain."""
    now = starts.select(F.col("url").alias("start")).where("start is not null").distinct().select("start", F.array("start").alias("chain"))
    links = fetched.where("next is not null").select(F.col("url").alias("at"), "next").join(fetched.select(F.col("url").alias("next")), "next", "left_semi")
    now = now.join(fetched.select(F.col("url").alias("start")), "start", "left_semi")
    for _ in range(pages - 1):  # a chain that has ended stays as it is
        step = now.join(links, F.element_at("chain", -1) == F.col("at"), "left")
        more = F.col("next").isNotNull() & ~F.array_contains("chain", F.col("next"))
        now = step.select("start", F.when(F.coalesce(more, F.lit(False)), F.array_append("chain", F.col("next"))).otherwise(F.col("chain")).alias("chain"))
    return now.select("start", F.posexplode("chain").alias("place", "url"))


def page_quality(html: Column, body: Column) -> Column:
    """``soft_404``, ``empty_body``, ``no_paragraphs``, ``short_text``, ``low_density``, ``few_paragraphs`` or ``ok``."""
    n = F.regexp_count(html, F.lit(r"(?i)<p[\s>]"))
    return (
        F.when(soft_404(html), "soft_404")
        .when(F.coalesce(F.length(html), F.lit(0)) == 0, "empty_body")
        .when(n == 0, "no_paragraphs")
        .when(F.length(body) < 200, "short_text")
        .when((F.length(html) > 5000) & (F.length(body) / F.length(html) < 0.005), "low_density")
        .when(n < 2, "few_paragraphs")
        .otherwise("ok")
    )


def site_profiles(pages: DataFrame, profiles: DataFrame, url: str = "url") -> DataFrame:
    """Pages with the first profile (``profiles``: domain, priority and more) whose domain is their host, without ``www.``, or a
    parent of it; null columns where there is none. A host's parents are its own few suffixes, so the join is on equal keys."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    hosts = pages.select(host.alias("_host")).where("_host <> ''").distinct()
    labels = F.split("_host", r"\.")
    up = hosts.select("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    fits = up.join(profiles.withColumn("domain", F.lower("domain")), "domain")
    best = fits.groupBy("_host").agg(F.min_by(F.struct(*profiles.columns), F.struct("priority", "domain")).alias("_profile"))
    return pages.withColumn("_host", host).join(best, "_host", "left").select(*pages.columns, "_profile.*")
