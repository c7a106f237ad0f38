"""Column functions over vectors, as higher-order expressions inside code generation: no Python in the rows' way."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, the error function's rational form
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once: inside a lambda Spark would compute it again for each element."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    """Sum of the values in double precision, in order."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """NaN where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / n)


def l2_normalize(v: Column) -> Column:
    """Norm in double, then a float division; the zero vector stays."""
    return let(norm(v).cast("float"), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float"))))


def is_usable(v: Column, dim: int) -> Column:
    """dim finite values, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def defect(v: Column, dim: int) -> Column:
    """Why a vector can't be used: null, length, non-finite, zero; null for a usable one."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull(), "null").when(F.size(v) != dim, "length").when(bad, "non-finite").when(~F.exists(v, lambda x: x != 0), "zero")


def layer_norm(v: Column, eps: float = 1e-5, gamma: Column | None = None) -> Column:
    """Scale only, no shift."""
    centred = let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x.cast("double") - mean))
    scale = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / F.size(c) + F.lit(eps))
    out = let(centred, lambda c: let(scale(c), lambda s: F.transform(c, lambda x: x / s)))
    return out if gamma is None else F.zip_with(out, gamma, lambda x, g: x * g)


def linear(v: Column, weights: Column) -> Column:
    """Rows of weights times the vector, no bias."""
    return F.transform(weights, lambda w: dot(w, v))


def split_heads(v: Column, parts: int, heads: int, head: int) -> Column:
    """A fused projection of width parts * heads * head as parts arrays of heads arrays."""
    part = lambda p: F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(v, h * head + p * heads * head + 1, head))
    return F.array(*[part(p) for p in range(parts)])


def rotary(v: Column, position: Column, dim: int, theta: float) -> Column:
    """Rotates the halves of a vector (not its neighbours) by position times theta^(-2i/dim)."""
    half = dim // 2
    angle = lambda i: position.cast("double") * F.pow(F.lit(theta), (F.pmod(i, F.lit(half)) * F.lit(-2.0)) / F.lit(float(dim)))
    turned = lambda i: F.when(i < half, -F.element_at(v, (i + half + 1).cast("int"))).otherwise(F.element_at(v, (i - half + 1).cast("int"))).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.element_at(v, (i + 1).cast("int")).cast("double") * F.cos(angle(i)) + turned(i) * F.sin(angle(i)))


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(a)
    return F.signum(x) * (F.lit(1.0) - poly * t * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return F.lit(0.5) * x * (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0))))


def silu(x: Column) -> Column:
    return x / (F.lit(1.0) + F.exp(-x))


def gated(v: Column, width: int, activation: str) -> Column:
    """The activated first half times the second half."""
    if activation not in ("gelu", "silu"):
        raise ValueError(f"activation {activation!r}")
    act = gelu if activation == "gelu" else silu
    return F.zip_with(F.slice(v, 1, width), F.slice(v, width + 1, width), lambda a, b: act(a.cast("double")) * b.cast("double"))


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def largest(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))


def int8_scale(v: Column) -> Column:
    """max |v| / 127; 1 for a zero row."""
    return let(largest(v), lambda m: F.when(m == 0, F.lit(1.0)).otherwise(m / 127.0))


def int8_codes(v: Column, scale: Column) -> Column:
    """Rounded half away from zero and clamped to -127..127."""
    return let(scale, lambda s: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / s).cast("int")))))


def int8_blocks(v: Column, dim: int, block: int) -> Column:
    """(scale, codes) of each block of a row."""
    parts = F.transform(F.sequence(F.lit(0), F.lit((dim - 1) // block)), lambda b: F.slice(v, b * block + 1, block))
    return F.transform(parts, lambda p: let(int8_scale(p), lambda s: F.struct(s.alias("scale"), int8_codes(p, s).alias("codes"))))


def dequantize(codes: Column, scale: Column) -> Column:
    return let(scale, lambda s: F.transform(codes, lambda q: q * s))


def strided(buffer: Column, rows: int, columns: int, row_stride: int) -> Column:
    """The logical rows x columns values of a buffer whose rows lie row_stride apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.element_at(buffer, (F.floor(i / columns) * row_stride + i % columns + 1).cast("int")))


def mean_pool(keep: Column, value: Column) -> Column:
    """Aggregate: the mean over kept tokens, 0 where none is kept."""
    return F.coalesce(F.avg(F.when(keep, value.cast("double"))), F.lit(0.0))
