"""External calls as replaceable column functions, with defaults that need no network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import let, words


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A vector of signed word counts by hash."""
    # a word's slot and sign are one number, hashed once; how many of each there are is what taking them away leaves out
    sign = lambda x: F.pmod(F.xxhash64(x, F.lit(1)), F.lit(2))
    marks = F.transform(words(F.lower(text)), lambda x: (F.pmod(F.xxhash64(x), F.lit(size)) * 2 + sign(x)).cast("int"))
    at = lambda m, i: (F.size(F.array_remove(m, i * 2 + 1)) - F.size(F.array_remove(m, i * 2))).cast("float")
    return let(marks, lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: at(m, i)))


def capitalised_names(text: Column, most: int = 40) -> Column:
    """Runs of capitalised words that don't start a sentence."""
    found = F.regexp_extract_all(text, F.lit(r"(?<=[\p{L},;:] )(\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,3})"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)


HOOKS: dict[str, Callable[[Column], Column]] = {"embed": hashed_embedding, "extract_entities": capitalised_names}


def register(name: str, f: Callable[[Column], Column]) -> None:
    HOOKS[name] = f


def hook(name: str) -> Callable[[Column], Column]:
    return HOOKS[name]
