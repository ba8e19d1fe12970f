"""URL filters: rules indexed by their rarest literal token.

Every rule is a regular expression over a URL's host and path (or the whole URL) together with the literal
tokens that any URL it fits must hold. How often those tokens occur is counted over all URLs; each rule is
filed under its rarest one. The tokens of a URL fetch the few rules filed under them, and only those run
their expressions. A rule without a token is refused: write it as several that have one each.

Of the fitting rules listed ones go first, then the longest wins; on equal length a block wins, then the rule named first. A
URL that no rule fits gets the default verdict. A null or empty URL, or one without ``://``, has an empty host and path. URLs
may be of any length. Each row gives one row, also if it repeats an id or has none; an empty table gives an empty result.
Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9_]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    over: str = "place"  # host and path; "url": the whole URL, lower-cased
    listed: bool = True  # named in the result


def domain_rule(name: str, verdict: str) -> Rule:
    """A rule written as host and path, such as ``example.net/en/``: the host and its subdomains, and paths
    that start with the path. Only the host's labels and the path's closed segments are sure tokens."""
    host, slash, path = name.partition("/")
    whole = path.rpartition("/")[0]
    tokens = tuple(dict.fromkeys(TOKEN.findall(host.lower()) + TOKEN.findall(whole.lower())))
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tokens)


#: The listed rules.
LISTED = (domain_rule("net/", "block"), domain_rule("example.net/en/", "allow"), domain_rule("example.com/de/", "block"), domain_rule("org/fr/", "allow"))
#: Beyond the list: tracking and advertising addresses are blocked.
PATTERNS = (
    Rule("utm", "block", r".*[?&]utm_source=", ("utm_source",), "url", False),
    *(Rule(t, "block", rf"[^/]*/(?:.*/)?{t}/", (t,), "place", False) for t in ("ads", "adserver", "banner")),
    *(Rule(t, "block", rf".*[?&]{t}=", (t,), "url", False) for t in ("gclid", "fbclid")),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit(r"([a-z0-9_]+)"), F.lit(1)))


def token_counts(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs each token of a rule occurs; one row for each such token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    asked = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))  # no more than the rules' tokens
    rows = pages.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(asked, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    return {t: 0 for t in wanted} | {r["token"]: r["n"] for r in rows}


class Index:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.rules = [(r, re.compile(r.pattern, re.DOTALL)) for r in rules]
        self.filed: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            if not r.tokens:
                raise ValueError(f"rule {r.name} has no literal token")
            self.filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)

    def candidates(self, url: str) -> list[int]:
        return [i for t in set(TOKEN.findall(url)) for i in self.filed.get(t, ())]

    def judge(self, url: str, host: str, path: str) -> Rule | None:
        low = url.translate(_LOWER)
        best, key = None, None
        for i in self.candidates(low):
            rule, pattern = self.rules[i]
            if pattern.match(host + path if rule.over == "place" else low):
                rank = (rule.listed, len(rule.name), rule.verdict == "block", -i)
                if key is None or rank > key:
                    best, key = rule, rank
        return best


_LOWER = str.maketrans(UPPER, LOWER)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict for every page. Listed rules go before patterns."""
    counts = token_counts(pages, rules)
    Index(rules, counts)  # refuses what can't be filed before any task runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for b in batches:
            found = [index.judge(u or "", h, p) for u, h, p in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([r.name if r and r.listed else None for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string"
    )


def sql() -> str:
    """The same in SQL, for the listed rules and patterns above."""
    host = f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's')"
    fits = " ".join(
        f"WHEN (host = '{n.partition('/')[0]}' OR ends_with(host, '.{n.partition('/')[0]}')) AND starts_with(path, '/{n.partition('/')[2]}') THEN '{n}'"
        for n in sorted((r.name for r in LISTED), key=len, reverse=True)
    )
    blocked = ", ".join(f"'{r.name}'" for r in LISTED if r.verdict == "block")
    allowed = ", ".join(f"'{r.name}'" for r in LISTED if r.verdict == "allow")
    return f"""
        WITH cut AS (
          SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        place AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS low, {host} AS host, {path} AS path FROM cut),
        found AS (SELECT *, CASE {fits} END AS rule FROM place)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IN ({allowed}) THEN 'allow'
                    WHEN regexp_matches(low, '[?&]utm_source=') OR regexp_matches(low, '[?&](gclid|fbclid)=')
                      OR regexp_matches(host || path, '^[^/]*/(.*/)?(ads|adserver|banner)/', 's') THEN 'block'
                    ELSE '{DEFAULT}' END AS verdict
        FROM found"""
