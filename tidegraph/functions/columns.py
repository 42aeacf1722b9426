"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Weight = Callable[[Column, Column], Column]


def endpoint_weight(src: Column, dst: Column) -> Column:
    """(src + dst) mod 128 + 1: an edge's length follows from its ends; file weights are ignored."""
    return F.pmod(src + dst, F.lit(128).cast("long")) + 1


def unit_weight(src: Column, dst: Column) -> Column:
    return F.lit(1).cast("long")


def no_weight(src: Column, dst: Column) -> Column:
    return F.lit(0).cast("long")


def is_tight(source_value: Column, weight: Column, value: Column) -> Column:
    return source_value.isNotNull() & value.isNotNull() & (source_value + weight == value)


def depends_on(source: Column, parent: Column) -> Column:
    """Whether a vertex rests on a deleted edge's source: its tight parent is that source."""
    return parent.eqNullSafe(source)


def label_depends(src: Column, dst: Column, src_label: Column, dst_label: Column) -> Column:
    """Whether a deleted edge can have carried dst's label: no loop, equal labels, dst not its own root."""
    return (src != dst) & (src_label == dst_label) & (dst_label < dst)


def is_active(residual: Column, epsilon: float) -> Column:
    return F.abs(residual) > epsilon


def is_urgent(waiting: Column, threshold: float, residual: bool = False) -> Column:
    """Whether a waiting value is ahead of the priority threshold: below it, or for residuals at least as large."""
    return F.abs(waiting) >= threshold if residual else waiting < threshold


def sampling_score(value: Column, waiting: Column, kind: str) -> Column:
    """What a vertex counts for when the next rounds are sampled.

    ``distance``: 2 if its value is over twice the waiting one, else 1; ``label``: 2 if the waiting one is less, else 1; ``residual``: the waiting residual's size.
    """
    if kind == "residual":
        return F.abs(waiting)
    return F.when(value > waiting * 2 if kind == "distance" else waiting < value, 2).otherwise(1)


def as_export(value: Column, infinity: str | int) -> Column:
    return F.coalesce(value.cast("string"), F.lit(str(infinity)))


def log2_bucket(degree: Column) -> Column:
    """floor(log2(degree)); -1 for degree 0."""
    return F.when(degree > 0, F.length(F.bin(degree)) - 1).otherwise(-1).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and named by a lambda: the expression does not hold a copy a use."""
    return F.transform(F.array(value), body)[0]


_MASK = 0xFFFFFFFF


def wrapped_product(a: Column, b: int) -> Column:
    """a * b modulo 2**64 as a signed long, exact also where overflow is an error."""
    low, high = b & _MASK, b >> 32 & _MASK
    mask = F.lit(_MASK).cast("long")

    def times32(x: Column, y: int) -> tuple[Column, Column]:
        """x * y of two unsigned 32-bit numbers as (high 32 bits, low 32 bits)."""
        y0, y1 = F.lit(y & 0xFFFF).cast("long"), F.lit(y >> 16).cast("long")
        p, q = x * y0, x * y1  # below 2**48
        low_sum = p.bitwiseAND(mask) + F.shiftleft(q.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
        return F.shiftrightunsigned(p, 32) + F.shiftrightunsigned(q, 16) + F.shiftrightunsigned(low_sum, 32), low_sum.bitwiseAND(mask)

    def whole(x: Column) -> Column:
        a0, a1 = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        carry, bottom = times32(a0, low)
        middle = carry + times32(a0, high)[1] + times32(a1, low)[1]
        return F.shiftleft(middle.bitwiseAND(mask), 32).bitwiseOR(bottom)

    return let(a, whole)


def wrapped_sum(a: Column, b: int) -> Column:
    """a + b modulo 2**64 as a signed long."""
    mask = F.lit(_MASK).cast("long")

    def whole(x: Column) -> Column:
        low = x.bitwiseAND(mask) + F.lit(b & _MASK).cast("long")
        high = F.shiftrightunsigned(x, 32) + F.lit(b >> 32 & _MASK).cast("long") + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))

    return let(a, whole)


def splitmix64(x: Column) -> Column:
    """SplitMix64 of a long; the result is the unsigned value's bits in a long.  The constants are fixed values."""
    z = wrapped_sum(x.cast("long"), 0x9E3779B97F4A7C15)
    z = wrapped_product(let(z, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, 30))), 0xBF58476D1CE4E5B9)
    z = wrapped_product(let(z, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, 27))), 0x94D049BB133111EB)
    return let(z, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, 31)))


def fnv1a(values: Column) -> Column:
    """FNV-1a over an array of longs, a whole value a step; for one bounded row of neighbours."""
    start = F.lit(0xCBF29CE484222325 - 2**64).cast("long")
    return F.aggregate(values, start, lambda h, x: wrapped_product(h.bitwiseXOR(x), 0x100000001B3))
