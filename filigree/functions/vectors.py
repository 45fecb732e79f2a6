"""Vector algebra on array columns, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _let(c: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it in a lambda."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def normalize(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""

    def by(u: Column, n: Column) -> Column:
        return F.when(n == 0, u).otherwise(F.transform(u, lambda x: x / n))

    return _let(v.cast("array<double>"), lambda u: _let(norm(u), lambda n: by(u, n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def combine(*weighted: tuple[Column, Column | float]) -> Column:
    """Weighted sum of vectors of one length."""
    parts = [_scaled(v, w) for v, w in weighted]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda x, y: x + y)
    return out


def _scaled(v: Column, w: Column | float) -> Column:
    w = F.lit(w) if isinstance(w, (int, float)) else w
    return F.transform(v, lambda x: x.cast("double") * w)


def edge_vector(v1: Column, v2: Column, v_type: Column, q: Column) -> Column:
    """normalize(q v1 + q v2 + (1 - q) v_type)."""
    return normalize(combine((v1, q), (v2, q), (v_type, F.lit(1.0) - q)))


def level_factor(level: Column, alpha: float = 0.5) -> Column:
    """1 + alpha (14 - level) / 13."""
    return F.lit(1.0) + F.lit(float(alpha)) * (F.lit(14) - level) / F.lit(13.0)


def triad_strength(w1: Column, w2: Column, w3: Column) -> Column:
    """w3^2 / sqrt(w1^4 + w2^4 + w3^4), 0 if all weights are 0."""

    def fourth(w: Column) -> Column:
        return w * w * w * w

    below = F.sqrt(fourth(w1) + fourth(w2) + fourth(w3))
    return F.when(below > 0, w3 * w3 / below).otherwise(F.lit(0.0))


def triad_vector(v1: Column, v2: Column, v3: Column, w1: Column, w2: Column, w3: Column) -> Column:
    return normalize(combine((v1, w1), (v2, w2), (v3, w3)))


def centroid(a: Column, b: Column) -> Column:
    """Unit vector between two vectors."""
    return normalize(F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")))


def floored(q: Column, same_word: Column, floor: float) -> Column:
    """Strength of a pair, raised to a floor for senses of one word."""
    return F.when(same_word, F.greatest(q, F.lit(float(floor)))).otherwise(q)


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
