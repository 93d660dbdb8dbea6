"""Vector, hash and score arithmetic as Column functions, in double precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in DOUBLE; null if either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, epsilon: float = 1e-12) -> Column:
    """v over its length; the length is bound once, not evaluated for each element."""
    return F.transform(F.array(F.sqrt(dot(v, v)) + epsilon), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def max_similarity(v: Column, others: Column) -> Column:
    """The largest dot product of v with any of an array of vectors; null if there is none."""
    return F.array_max(F.transform(others, lambda o: dot(v, o)))


def fuse(first: Column, second: Column, alpha: float) -> Column:
    return alpha * first + (1 - alpha) * second


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_text(a: Column, b: Column) -> Column:
    """Differing places of two bit strings."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def sign_hash(v: Column, bits: int = 60) -> Column:
    """A bit for each of the first elements that is positive."""
    return reduce(lambda a, b: a + b, [F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(bits)]).cast("bigint")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded half to even in binary arithmetic: what a double's decimal spelling says at half-way values isn't what it holds."""
    x = x.cast("double")
    return F.rint(x * float(10**digits)) / float(10**digits) if digits else F.rint(x)


def fit_long_side(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Width and height scaled down so that the longer side is at most longest."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.greatest(F.lit(1), F.floor(width * scale)).cast("int"), F.greatest(F.lit(1), F.floor(height * scale)).cast("int")


def fit_short_side(width: Column, height: Column, shortest: int) -> tuple[Column, Column]:
    scale = F.least(F.lit(1.0), F.lit(float(shortest)) / F.least(width, height))
    return half_even(width * scale).cast("int"), half_even(height * scale).cast("int")


def fit_pixels(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (width * height)))
    return F.greatest(F.lit(1), F.floor(width * scale)).cast("int"), F.greatest(F.lit(1), F.floor(height * scale)).cast("int")


def backoff(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds before an attempt: doubling, up to a bound."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def char_budget(texts: Column, most: int) -> Column:
    """Every text cut to an equal share of most characters."""
    share = F.floor(F.lit(most) / F.greatest(F.size(texts), F.lit(1))).cast("int")
    return F.transform(texts, lambda t: F.substring(t, F.lit(1), share))
