"""Vector expressions in double precision, and the embedding that needs no model."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def query_vector(values) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def distance(a: Column, b: Column, kind: str = "cosine") -> Column:
    """cosine: 1 - cosine, null for a zero vector; l2: Euclidean; dot: the negative inner product."""
    if kind == "cosine":
        return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    if kind == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))
    if kind == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown distance: {kind}")


def normalised(a: Column) -> Column:
    """To unit length; the norm is computed once, not once a component. The zero vector stays."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))))


def shortened(a: Column, dim: int) -> Column:
    """The first dim components, to unit length."""
    return normalised(F.slice(a, 1, dim))


def fallback_embedding(text: Column, dim: int = 1024) -> Column:
    """md5's 16 bytes scaled to [-1, 1], zeros up to dim, to unit length; a blank or null text is the zero vector."""
    t = F.coalesce(text, F.lit(""))
    places = F.sequence(F.lit(0), F.lit(min(16, dim) - 1))
    raw = let(F.md5(t.cast("binary")), lambda digest: F.transform(places, lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1))
    zero = F.array_repeat(F.lit(0.0), dim)
    full = F.concat(normalised(raw), F.array_repeat(F.lit(0.0), max(dim - 16, 0)))
    return F.when(F.trim(t) == "", zero).otherwise(full)


def pack(values) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(values)}f", *values)


def unpack(raw: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


def batch_embedder(embed, schema: str = "array<float>"):
    """A pandas UDF around embed(list of texts) -> list of vectors, called once an Arrow batch; for real models."""

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.fillna("").tolist()))

    return run
