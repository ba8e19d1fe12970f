"""Functions over content: headings, answers, plans and keywords as JSON, dates, images."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import jaccard, squeeze, strip, words

#: Formats of dates in pages, tried in order.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm", "dd.MM.yyyy")
#: Elements and attributes that run code or frame other pages.
DANGEROUS = r"(?is)<(script|style|iframe|object|embed|form)\b.*?</\1\s*>"
HANDLERS = r"(?is)\s(?:on\w+|srcdoc)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"


def is_heading(line: Column) -> Column:
    """Short, without closing punctuation, and all capitals or ended by a colon or marked as a heading."""
    t = F.trim(line)
    short = F.length(t).between(3, 80) & (F.size(words(t)) <= 10)
    capitals = (F.upper(t) == t) & F.rlike(t, F.lit(r"\p{L}"))
    return short & ~F.rlike(t, F.lit(r"[.!?…]$")) & (capitals | F.endswith(t, F.lit(":")) | F.startswith(t, F.lit("#")))


def is_substantive(answer: Column, least: int = 120) -> Column:
    return F.length(F.trim(F.coalesce(answer, F.lit("")))) >= least


def page_date(text: Column) -> Column:
    """UTC; null if no format fits."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS))


def strip_dangerous(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, DANGEROUS, ""), HANDLERS, "")


def ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, by longest matching blocks."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def image_score(post: Column, image: Column, depicts: Column, boost: float = 0.20) -> Column:
    """Token overlap of a post and what is known of an image, more if the post names what it shows."""
    tokens = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 3))
    named = F.exists(F.coalesce(depicts, F.array().cast("array<string>")), lambda d: F.contains(F.lower(post), F.lower(d)))
    return jaccard(tokens(post), tokens(image)) + F.when(named, boost).otherwise(0.0)


#: What stands for an unnamed person in captions, tried in order.
UNNAMED = (
    r"\b[Bb]ir\s+(?:erkek\s+)?adam(?:ın)?\b",
    r"\b[Bb]ir\s+kadın\b",
    r"\b[Bb]ir\s+kişi\b",
    r"\b[Bb]ir\s+(?:erkek|bayan)\b",
    r"\b(?:[Bb]ir\s+)?(?:takım\s+elbiseli|kıyafetli)\s+(?:bir\s+)?(?:adam|kadın|kişi)(?:ın)?\b",
)


def names_it(text: Column, name: Column) -> Column:
    """Whether a text holds a word of three letters or more of a name."""
    parts = F.filter(words(F.lower(name)), lambda p: F.length(p) >= 3)
    return F.exists(parts, lambda p: F.rlike(F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), p, F.lit(r"\E\b"))))


def enrich_caption(caption: Column, depicts: Column, alt: Column) -> Column:
    """A caption with the first person it shows (capitalised, three letters or more) that it doesn't name: instead of the first
    unnamed person in it, else in front. A name that the alternative text, if there is one, doesn't hold is not trusted."""
    text, other = F.coalesce(caption, F.lit("")), F.coalesce(alt, F.lit(""))
    people = F.filter(F.transform(F.coalesce(depicts, F.array().cast("array<string>")), strip), lambda n: F.rlike(n, F.lit(r"^\p{Lu}")) & (F.length(n) >= 3))
    name = F.try_element_at(F.filter(people, lambda n: ((other == "") | names_it(other, n)) & ~names_it(text, n)), F.lit(1))
    quoted = F.regexp_replace(name, r"([\\$])", r"\\$1")
    out = F.concat(name, F.lit(", "), F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
    for p in reversed(UNNAMED):
        out = F.when(F.rlike(text, F.lit(f"(?U){p}")), F.regexp_replace(text, F.lit(f"(?sU)^(.*?){p}"), F.concat(F.lit("$1"), quoted))).otherwise(out)
    return F.when((text == "") | name.isNull(), text).otherwise(out)


def last_json(text: Column) -> Column:
    """The last JSON object or array of a text, without code fences; null if there is none. Runs are taken whole, so that a long one is no deep recursion."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)((?:\{(?:[^{}]++|\{[^{}]*+\})*+\}|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\]))(?!.*[}\]])", 1), F.lit(""))


def chunk_keywords(text: Column, most: int = 5, questions: int = 3) -> Column:
    """A struct of keywords (lower-cased, 1 to 80 characters) and questions (5 to 200), null where there are none."""
    j = F.from_json(last_json(text), "struct<keywords:array<string>,questions:array<string>>")
    k = F.slice(F.filter(F.transform(j["keywords"], lambda x: F.lower(F.trim(x))), lambda x: F.length(x).between(1, 80)), 1, most)
    q = F.slice(F.filter(F.transform(j["questions"], lambda x: F.trim(x)), lambda x: F.length(x).between(5, 200)), 1, questions)
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.struct(some(k).alias("keywords"), some(q).alias("questions"))


#: Classes a plan may have; the first is the default.
PLAN_CLASSES = ("news_query", "general_knowledge", "meta_query")


def valid_plan(text: Column, request: Column) -> Column:
    """A plan's JSON made valid: known class, topic of at most 200 characters, five keywords (the topic's words if there
    are none), a count from 1 to 10, five time frames, three critical entities of 3 to 30 characters that the
    request holds, and whether the request is short."""
    j = F.from_json(last_json(text), "struct<query_class:string,topic_query:string,keywords:array<string>,count:int,timeframes:array<string>,critical_entities:array<string>>")
    topic = F.substring(F.coalesce(F.nullif(F.trim(j["topic_query"]), F.lit("")), F.trim(request)), 1, 200)
    given = F.coalesce(F.filter(j["keywords"], lambda k: F.trim(k) != ""), F.array().cast("array<string>"))
    held = F.filter(F.transform(F.coalesce(j["critical_entities"], F.array().cast("array<string>")), lambda e: squeeze(F.lower(e))), lambda e: F.length(e).between(3, 30) & F.contains(F.lower(request), e))
    return F.struct(
        F.when(j["query_class"].isin(*PLAN_CLASSES), j["query_class"]).otherwise(PLAN_CLASSES[0]).alias("query_class"),
        topic.alias("topic_query"),
        F.slice(F.when(F.size(given) > 0, given).otherwise(words(F.lower(topic))), 1, 5).alias("keywords"),
        F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(j["count"], F.lit(1)))).alias("count"),
        F.slice(F.coalesce(j["timeframes"], F.array().cast("array<string>")), 1, 5).alias("timeframes"),
        F.slice(F.array_distinct(held), 1, 3).alias("critical_entities"),
        (F.size(words(request)) <= 2).alias("short"),
    )
