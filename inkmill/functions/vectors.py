"""Vector arithmetic over array<double> columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)")


def norm(a: str) -> Column:
    return F.sqrt(F.expr(f"aggregate({a}, 0D, (s, x) -> s + double(x) * double(x))"))


def normalise(a: str) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = f"sqrt(aggregate({a}, 0D, (s, x) -> s + double(x) * double(x)))"
    return F.expr(f"transform(array({length}), n -> transform({a}, x -> double(x) / if(n = 0, 1D, n)))[0]")


def cosine(a: str, b: str) -> Column:
    """0 where either norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / both)


def tfidf_weights(at: str, n: str, idf: list[float]) -> Column:
    """(1 + ln n) * idf of the places ``at``, of unit length."""
    if not idf:
        return F.expr("cast(array() as array<double>)")
    listed = f"array({', '.join(repr(float(x)) + 'D' for x in idf)})"
    raw = f"zip_with({at}, {n}, (a, k) -> (1 + ln(k)) * {listed}[a])"
    return F.expr(f"transform(array({raw}), w -> transform(array(sqrt(aggregate(w, 0D, (s, x) -> s + x * x))), l -> transform(w, x -> x / if(l = 0, 1D, l)))[0])[0]")
