"""Column expressions on vectors of an exact integer grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the grid per unit.
SCALE = 10000


def round_half_away(x: Column, scale: int = SCALE) -> Column:
    """x on the grid, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def quantise(vec: Column, scale: int = SCALE) -> Column:
    """Grid steps of each component, halves up: the domain in which distances are exact."""
    return F.transform(vec, lambda e: F.floor(e.cast("double") * F.lit(float(scale)) + F.lit(0.5)).cast("long"))


def quantise_even(vec: Column, scale: int = SCALE) -> Column:
    """Grid steps of each component, halves to even, as index mirrors are written."""
    return F.transform(vec, lambda e: F.rint(e.cast("double") * F.lit(float(scale))).cast("long"))


def quantise_away(vec: Column, scale: int = SCALE) -> Column:
    """Grid steps of each component, halves away from zero, as benchmarks write 16-bit mirrors."""
    return F.transform(vec, lambda e: (F.signum(e.cast("double")) * F.floor(F.abs(e.cast("double")) * F.lit(float(scale)) + F.lit(0.5))).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    """Squared distance of two integer vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def norm_squared(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x * x)


def l2_squared_by_norms(a: Column, b: Column) -> Column:
    """The same distance from norms and an inner product, which lets norms be stored."""
    return norm_squared(a) + norm_squared(b) - 2 * dot(a, b)


def partial_distance(a: Column, b: Column) -> Column:
    """The distance of b from the query a less the query's norm: ranks as the distance does, but is none."""
    return norm_squared(b) - 2 * dot(a, b)


def megabytes(rows: Column, dims: int = 14, width: int = 4) -> Column:
    """Size of so many vectors in 10^6 bytes."""
    return rows * F.lit(dims * width) / F.lit(1e6)


def euclidean(d2: Column, scale: int = SCALE) -> Column:
    """Distance in units from a squared distance in grid steps."""
    return F.sqrt(F.greatest(d2, F.lit(0)).cast("double")) / F.lit(float(scale))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def register_sql(spark) -> None:
    """l2sq and norm2 as SQL functions of the session, made of built-ins alone."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2sq(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0L, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm2(a ARRAY<BIGINT>) RETURNS BIGINT RETURN aggregate(a, 0L, (s, x) -> s + x * x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gelu(x DOUBLE) RETURNS DOUBLE RETURN 0.5D * x * (1D + tanh(0.7978845608028654D * (x + 0.044715D * x * x * x)))")
