"""Column expressions shared by the operators. All stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is 0 (a plain division raises under ANSI)."""
    return F.try_divide(col(a), col(b))


# ---- hashing: the same values in any engine with md5 ---------------------------------------------------------

def hash_key(seed, *keys: str | Column) -> Column:
    """md5 of seed:key1:key2…, used as a deterministic random order."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head.cast("string"), *[col(k).cast("string") for k in keys]))


def hash_unit(seed, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def hash_normal(seed, *keys: str | Column) -> Column:
    """Standard normal number by Box-Muller over two hash uniforms."""
    u = (hash_unit(f"{seed}/u", *keys) + F.lit(0.5 / 2**32))
    v = hash_unit(f"{seed}/v", *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * v)


# ---- arrays ---------------------------------------------------------------------------------------------------

def asum(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return asum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; inside a lambda it would be recomputed per element."""
    return F.transform(F.array(value), body)[0]


def unit(a: str | Column, eps: float = 0.0) -> Column:
    """Array divided by its Euclidean norm (+eps)."""
    return let(F.sqrt(dot(a, a)) + F.lit(eps), lambda n: F.transform(col(a), lambda v: F.try_divide(v, n)))


def softmax(a: str | Column, scale: float | Column = 1.0) -> Column:
    """exp(scale·(a − max)) / Σ, stable."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    e = let(F.array_max(col(a)), lambda top: F.transform(col(a), lambda v: F.exp(s * (v - top))))
    return let(e, lambda z: let(asum(z), lambda total: F.transform(z, lambda v: v / total)))


def amean(a: Column) -> Column:
    return F.try_divide(asum(a), F.size(a))


def centre(a: Column) -> Column:
    return let(amean(a), lambda m: F.transform(a, lambda v: v - m))


def astd(a: Column) -> Column:
    """Population standard deviation of an array."""
    return let(centre(a), lambda c: F.sqrt(asum(F.transform(c, lambda v: v * v)) / F.size(c)))


def argmax0(a: str | Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def zip_mean(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: (x + y) / 2.0)


def zip_product(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x * y)


def zip_weighted(wa: Column, a: str | Column, wb: Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: wa * x + wb * y)


def cosine(a: str | Column, b: str | Column) -> Column:
    return safe_div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def edges_above(c: str | Column, edges: list[float]) -> Column:
    """How many of the (few, fixed) edges lie strictly below the value: an exact half-open bin lookup."""
    if isinstance(c, str):
        return F.expr(" + ".join(f"int(`{c}` > {e!r}D)" for e in edges))
    return reduce(lambda x, y: x + y, [(c > F.lit(e)).cast("int") for e in edges])


def vector_sum(a: str | Column) -> Column:
    """Element-wise sum of arrays over a group, with partial sums on the map side."""
    return vector_to_array(Summarizer.sum(array_to_vector(col(a))))
