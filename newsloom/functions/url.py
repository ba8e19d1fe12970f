"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_referrer", "fbclid", "gclid", "yclid",
    "msclkid", "mc_cid", "mc_eid", "_ga", "ref", "ref_src", "ref_url", "source", "share", "share_origin", "spm",
)
#: What is not an article, and why; the first that fits counts.
SKIPPED = (
    (r"(?i)/live-blog/", "live-blog"),
    (r"(?i)/canli-(?:blog|haber|yayin|takip)/", "canli-blog"),
    (r"(?i)/canli-(?:altin|doviz|borsa|petrol|skor)", "canli-veri"),
    (r"(?i)/canli/(?:altin|doviz|borsa|petrol)", "canli-veri"),
    (r"(?i)/video/", "video"),
    (r"(?i)/videolar/", "video"),
)
#: Where an article's own number stands in its URL.
NUMBERED = (r"/haber/(\d+)(?:\.html?)?(?:/|\?|$)", r"\b(\d{6,})(?:\.html?)?(?:/|\?|$)")


def part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, single slashes, no tracking parameters or blank values,
    the other parameters by name, no fragment. A URL without a scheme gets ``https``."""
    scheme = F.coalesce(F.nullif(F.lower(part(url, r"^([A-Za-z][A-Za-z0-9+.-]*):")), F.lit("")), F.lit("https"))
    host = F.lower(part(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(part(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"), "/{2,}", "/")
    pairs = F.filter(F.split(part(url, r"^[^?#]*\?([^#]*)"), "&"), lambda p: F.contains(p, F.lit("=")) & ~F.endswith(p, F.lit("=")))
    kept = F.filter(pairs, lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))), lambda s: s["p"]), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url == "", url).otherwise(whole)


def external_id(url: Column) -> Column:
    return F.coalesce(*(F.nullif(part(url, p), F.lit("")) for p in NUMBERED))


def skip_reason(url: Column) -> Column:
    """Null if the URL may be an article."""
    out = F.when(F.lit(False), "")
    for pattern, reason in SKIPPED:
        out = out.when(F.rlike(url, F.lit(pattern)), reason)
    return out


def validity(url: Column) -> Column:
    """``ok``, ``empty``, ``no_scheme`` or ``no_hostname``."""
    empty = F.coalesce(F.trim(url), F.lit("")) == ""
    return F.when(empty, "empty").when(~F.rlike(url, F.lit("^(?i)https?://")), "no_scheme").when(part(url, r"^(?i)https?://([^/?#]*)") == "", "no_hostname").otherwise("ok")


def provisional_title(url: Column) -> Column:
    """The last path segment without its number, words parted, at most 200 characters."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    slug = F.regexp_replace(F.substring_index(path, "/", -1), r"(,\d+|-[0-9a-f]{8})$", "")
    return F.substring(F.trim(F.regexp_replace(slug, "[-_]+", " ")), 1, 200)


def next_link(html: Column) -> Column:
    """Where the first ``a`` or ``link`` that says it is the next page leads to, as it is written; null if there is none."""
    tag = F.regexp_extract(html, r"(?i)<(?:a|link)\s(?:[^>]*\s)?rel\s*=\s*[\"']?next\b[^>]*>", 0)
    href = lambda i: F.nullif(F.regexp_extract(tag, r"(?i)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", i), F.lit(""))
    return F.replace(F.coalesce(href(1), href(2), href(3)), F.lit("&amp;"), F.lit("&"))


def page_urls(url: Column, param: str, start: int = 1, pages: int = 5) -> Column:
    """The URL with its page parameter set to each page; the URL alone without a parameter."""
    if not param:
        return F.array(url)
    bare = F.regexp_replace(F.regexp_replace(url, rf"([?&]){param}=[^&#]*&?", "$1"), r"[?&]$", "")
    joint = F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.transform(F.sequence(F.lit(start), F.lit(start + pages - 1)), lambda i: F.concat(bare, joint, F.lit(f"{param}="), i.cast("string")))
