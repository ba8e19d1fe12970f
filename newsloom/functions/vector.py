"""Vectors as arrays of float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def semantic(a: Column, b: Column) -> Column:
    """The cosine moved to 0..1."""
    return (cosine(a, b) + 1) / 2


def sign_bits(a: Column) -> Column:
    """Signs packed into longs, 32 to each: bit i is set if the value is above 0."""
    words = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 32).cast("int"))
    return F.transform(
        words,
        lambda w: F.aggregate(
            F.transform(F.slice(a, w * 32 + 1, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda s, x: s + x,
        ),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def parse(literal: Column) -> Column:
    return F.from_json(literal, "array<float>")


def to_literal(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.7f", x.cast("double"))), ","), F.lit("]"))
