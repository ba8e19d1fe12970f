"""Vectors of whole numbers: each component scaled and floored, rows that can't be scaled left out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squared lengths stay below this, so that sums of products are whole numbers that doubles hold exactly.
EXACT = float(1 << 53)


def scaled(embeddings: DataFrame, scale: int) -> DataFrame:
    """``embeddings`` with ``v``, the floors of ``scale`` times each component, and ``vv``, its squared length. Rows whose
    vector is null, or holds a null or non-finite component, are left out."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    far = F.aggregate(x, F.lit(0.0), lambda s, c: F.greatest(s, F.abs(c.cast("double")))) * scale
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    exact = F.when((far + 1) * (far + 1) * F.size(x) < EXACT, v).otherwise(F.raise_error(F.lit("components are too large for exact sums")).cast("array<bigint>"))
    kept = embeddings.where(fine).withColumn("v", exact)
    return kept.withColumn("vv", F.aggregate("v", F.lit(0.0), lambda s, c: s + (c * c).cast("double")))


def matrix(vectors, dims: int) -> np.ndarray:
    """One row for each vector, filled up with zeros to ``dims``."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out
