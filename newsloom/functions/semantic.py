"""Chunks that end where the meaning turns: headings, paragraphs unlike the one before, and a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import vector
from newsloom.functions.text import estimate_tokens, let, paragraphs, sentences, strip, title_prefix


@dataclass(frozen=True)
class SemanticConfig:
    min_tokens: int = 150
    target_tokens: int = 400
    max_tokens: int = 800
    overlap_sentences: int = 2
    percentile: float = 25


UNIT = "struct<text:string,heading:boolean,first:boolean,n:int>"


def is_section(paragraph: Column) -> Column:
    """A paragraph that is a heading: marked as one, or 5 to 80 characters in capitals without closing punctuation whose first
    20 hold no space."""
    capitals = F.length(paragraph).between(5, 80) & (F.upper(paragraph) == paragraph) & ~F.rlike(paragraph, F.lit(r"[.!?]$")) & ~F.contains(F.substring(paragraph, 1, 20), F.lit(" "))
    return F.startswith(paragraph, F.lit("#")) | capitals


def units(text: Column) -> Column:
    """Headings whole, other paragraphs by sentences, in order."""
    unit = lambda s, heading, first: F.struct(s.alias("text"), heading.alias("heading"), first.alias("first"), estimate_tokens(s).alias("n"))
    of = lambda p: F.when(is_section(p), F.array(unit(p, F.lit(True), F.lit(True)))).otherwise(F.transform(sentences(p), lambda s, i: unit(s, F.lit(False), i == 0)))
    return F.flatten(F.transform(paragraphs(text), of))


def quantile(values: Column, percent: float) -> Column:
    """Of sorted values, with linear interpolation."""
    at = (F.size(values) - 1) * (percent / 100)
    low = F.try_element_at(values, F.floor(at).cast("int") + 1)
    return low + (F.try_element_at(values, F.ceil(at).cast("int") + 1) - low) * (at - F.floor(at))


def breaks(u: Column, vectors: Column | None, cfg: SemanticConfig) -> Column:
    """For each unit whether a chunk may end before it: a heading, or a paragraph's start less like the unit before it than the
    percentile of all such neighbours. Fewer than four neighbours say nothing."""
    heading = F.transform(u, lambda x, i: x["heading"] & (i > 0))
    if vectors is None:
        return heading

    def like(v: Column, lengths: Column, before: Column, x: Column, i: Column) -> Column:
        """The cosine; a vector's length is worked out once, not once for each neighbour."""
        n = F.try_element_at(lengths, before) * F.try_element_at(lengths, i + 1)
        return F.when(n > 0, vector.dot(F.try_element_at(v, before), x) / n).otherwise(0.0)

    def turned(v: Column) -> Column:
        near = lambda l: F.transform(v, lambda x, i: F.when((i > 0) & x.isNotNull(), like(v, l, F.greatest(i, F.lit(1)), x, i)))
        return let(let(F.transform(v, vector.norm), near), lambda s: let(F.array_sort(F.array_compact(s)), lambda known: F.transform(heading, lambda h, i: h | F.coalesce((F.size(known) >= 4) & (F.try_element_at(s, i + 1) < quantile(known, cfg.percentile)) & F.try_element_at(u, i + 1)["first"], F.lit(False)))))

    return let(vectors, turned)


def semantic_chunk(text: Column, embed: Callable[[Column], Column] | None = None, title: Column | None = None, subtitle: Column | None = None, cfg: SemanticConfig = SemanticConfig()) -> Column:  # noqa: B008
    """An array of (chunk_index, chunk_text, token_count). ``embed`` turns the array of a text's sentences into one of vectors (one
    call for a text); without it headings and the budget alone decide. A chunk closes before a break once it has the
    least size, before a unit that would pass the hard limit, and before a paragraph that would pass the target. A short last
    chunk joins the one before it; each chunk starts with the last two units of the one before, headings left out, after the titles.
    Null and blank texts give none."""
    chunk_type = f"struct<units:array<{UNIT}>,n:int>"
    no_units, no_chunks = F.array().cast(f"array<{UNIT}>"), F.array().cast(f"array<{chunk_type}>")
    state = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"))
    one = lambda us, n: F.array(F.struct(us.alias("units"), n.cast("int").alias("n")))

    def step(a: Column, x: Column) -> Column:
        u, n = x["u"], a["n"] + x["u"]["n"]
        full = (F.size(a["cur"]) > 0) & ((x["b"] & (a["n"] >= cfg.min_tokens)) | (n > cfg.max_tokens) | ((n > cfg.target_tokens) & (a["n"] >= cfg.min_tokens) & u["first"]))
        return F.when(full, state(F.concat(a["done"], one(a["cur"], a["n"])), F.array(u), u["n"])).otherwise(state(a["done"], F.concat(a["cur"], F.array(u)), n))

    def end(a: Column) -> Column:
        last = F.try_element_at(a["done"], F.lit(-1))
        joined = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), one(F.concat(last["units"], a["cur"]), last["n"] + a["n"]))
        return F.when(F.size(a["cur"]) == 0, a["done"]).when((a["n"] < cfg.min_tokens) & (F.size(a["done"]) > 0), joined).otherwise(F.concat(a["done"], one(a["cur"], a["n"])))

    def packed(u: Column) -> Column:
        total = F.aggregate(u, F.lit(0), lambda s, x: s + x["n"])
        b = breaks(u, embed(F.transform(u, lambda x: x["text"])) if embed else None, cfg)
        pairs = F.zip_with(u, b, lambda x, y: F.struct(x.alias("u"), y.alias("b")))
        return F.when(total < cfg.min_tokens, F.when(F.size(u) > 0, one(u, total)).otherwise(no_chunks)).otherwise(F.aggregate(pairs, state(no_chunks, no_units, F.lit(0)), step, end))

    def written(chunks: Column) -> Column:
        def row(c: Column, i: Column) -> Column:
            before = F.try_element_at(chunks, F.greatest(i, F.lit(1)))["units"]
            tail = F.slice(before, F.greatest(F.size(before) - (cfg.overlap_sentences - 1), F.lit(1)), F.lit(cfg.overlap_sentences))
            body = F.concat(F.when(i > 0, F.filter(tail, lambda x: ~x["heading"])).otherwise(no_units), c["units"])
            whole = strip(F.concat(title_prefix(title, subtitle), F.array_join(F.transform(body, lambda x: x["text"]), " ")))
            return let(whole, lambda w: F.struct(i.alias("chunk_index"), w.alias("chunk_text"), estimate_tokens(w).alias("token_count")))

        return F.transform(chunks, row)

    return let(let(units(text), packed), written)
