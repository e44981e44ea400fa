"""Column expressions that the operators share; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_hash(x: Column, a: int, b: int, prime: int, size: int) -> Column:
    """((a * x + b) mod prime) mod size, for x >= 0; a * x must stay inside 63 bits."""
    return F.pmod(F.pmod(F.lit(a) * x.cast("long") + F.lit(b), F.lit(prime)), F.lit(size))


def hash_values(x: Column, coefficients: list[tuple[int, int]], prime: int, size: int) -> Column:
    """The k hash values of x as an array."""
    return F.array(*[linear_hash(x, a, b, prime, size) for a, b in coefficients])


def trailing_zeros(x: Column) -> Column:
    """Zeros at the end of the binary form; 0 for 0."""
    b = F.bin(x)
    return F.when(x == 0, 0).otherwise(F.length(b) - F.length(F.regexp_replace(b, "0+$", "")))


def text_id(x: Column) -> Column:
    """A stable 32-bit number of a string, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def strip_zeros(x: Column) -> Column:
    return F.regexp_replace(x, "^0+", "")


def short_date(d: Column) -> Column:
    return F.date_format(d, "M/d/yy")


def mahalanobis(x: Column, mean: Column, sigma: Column) -> Column:
    """Normalised distance; a dimension without spread counts only as its plain difference."""
    parts = F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), sigma, lambda d, s: F.pow(d / F.when(s > 0, s).otherwise(1.0), 2))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda t, v: t + v))


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)


def fallback(*columns: Column) -> Column:
    """The first that isn't null."""
    return F.coalesce(*columns)
