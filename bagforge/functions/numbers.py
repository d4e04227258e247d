"""Column expressions over numbers: kernels, ranges, and hashes that other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def triweight(x: Column) -> Column:
    """35/32 (1 - x^2)^3 for distances x below 1, else null."""
    y = 1 - x * x
    return F.when(x < 1, 35 / 32 * y * y * y)


def kernel(width: float, x: Column) -> Column:
    """The triweight kernel of a width, whose integral is that of width 1; 0 from the width on."""
    return F.when(x >= width, 0.0).otherwise(triweight(x / width) / width)


def approx_equal(epsilon: float, x: Column, y: Column) -> Column:
    """y within epsilon of x, ends included."""
    return y.between(x - epsilon, x + epsilon)


def each_within(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Two ranges reach into each other."""
    return (low_a <= high_b) & (low_b <= high_a)


def draw(key: str | Column, seed: int) -> Column:
    """A number from 0 to 2^60 - 1 that only the key's text and the seed decide: 15 digits of an MD5, so that other engines can repeat it."""
    text = F.concat_ws(":", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


#: The prime that `place` works by.
PRIME = 2**31 - 1


def place(key: str, number: int, size: int) -> Column:
    """One of `size` places for an integer key: function `number` of a family a x + b modulo PRIME."""
    a, b = pow(48271, 2 * number + 1, PRIME), pow(48271, 2 * number + 2, PRIME)
    return F.pmod(F.pmod(F.pmod(F.col(key).cast("long"), F.lit(PRIME)) * F.lit(a).cast("long") + F.lit(b), F.lit(PRIME)), F.lit(size)).cast("int")
