"""Column functions: bins, directions, symbols, vectors and guarded arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTORS = 16


def bin_of(coord: Column, size: int, origin: Column | int = 0) -> Column:
    """B2: bin number of a pixel coordinate."""
    return F.floor((coord - origin) / size).cast("long")


def flat_row(bx: Column, by: Column, ny: Column) -> Column:
    """B2: row of a bin in the flattened grid."""
    return bx * ny + by


def unflat(row: Column, ny: Column) -> tuple[Column, Column]:
    """B2: bin of a flat row."""
    return F.floor(row / ny).cast("long"), F.pmod(row, ny)


def direction_class(dx: Column, dy: Column, foreground: Column | None = None) -> Column:
    """Sector 0..15 of a vector, x first; the zero vector and background rows are class 0.

    Axes and diagonals are decided on the coordinates, so that rounding never moves them."""
    angle = F.pmod(F.atan2(dx.cast("double"), dy.cast("double")), F.lit(2 * math.pi))
    cls = (
        F.when((dx == 0) & (dy >= 0), 0)
        .when((dx == dy) & (dx > 0), 2)
        .when((dy == 0) & (dx > 0), 4)
        .when((dx == -dy) & (dx > 0), 6)
        .when((dx == 0) & (dy < 0), 8)
        .when((dx == dy) & (dx < 0), 10)
        .when((dy == 0) & (dx < 0), 12)
        .when((dx == -dy) & (dx < 0), 14)
        .otherwise(F.pmod(F.floor(angle / (2 * math.pi / SECTORS)), F.lit(SECTORS)))
    ).cast("long")
    return cls if foreground is None else F.when(foreground, cls).otherwise(F.lit(0).cast("long"))


def one_hot(cls: Column, foreground: Column) -> Column:
    """16 flags, all zero for background."""
    return F.transform(F.sequence(F.lit(0), F.lit(SECTORS - 1)), lambda i: F.when(foreground & (i == cls), 1).otherwise(0))


def split_field(c: Column) -> Column:
    """G1: aliases of a field split on | ; and comma, trimmed, upper case, without empties and dashes."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[|;,]"), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: (x != "") & (x != "-"))


def gene_symbol(name: Column, identifier: Column) -> Column:
    """Upper-case name, or the identifier where the name is empty; NUL padding removed."""
    bare = lambda c: F.nullif(F.rtrim(F.translate(c, "\0", "")), F.lit(""))
    return F.upper(F.coalesce(bare(name), bare(identifier)))


def gene_identifier(name: Column, identifier: Column) -> Column:
    """The identifier, or the name where it is empty."""
    bare = lambda c: F.nullif(F.rtrim(F.translate(c, "\0", "")), F.lit(""))
    return F.coalesce(bare(identifier), bare(name))


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the values joined by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *(c.cast("string") for c in cols)), 256)


def vec_dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vec_norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(vec_dot(a, a))


def is_mt(symbol: Column) -> Column:
    """Mitochondrial symbols."""
    return F.startswith(F.upper(symbol), F.lit("MT-"))


def safe_div(a: Column, b: Column) -> Column:
    """A / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def clip(c: Column, low: float, high: float) -> Column:
    """C within [low, high]."""
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def log2_bin(c: Column) -> Column:
    """floor(log2(c)), counts below 1 as 1; taken from the binary digits, so it is exact."""
    return (F.length(F.bin(F.greatest(c.cast("long"), F.lit(1)))) - 1).cast("long")


def quantile_bin(c: Column, cuts: Column) -> Column:
    """Number of cut points below c."""
    return F.size(F.filter(cuts, lambda x: x < c)).cast("long")


def hash_order(*parts: Column | str | int) -> Column:
    """A deterministic shuffle key."""
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))
