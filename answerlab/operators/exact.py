"""Sums that are the same on any partitioning, to the last bit.

A double is a whole number of a power of two, so it can be cut into whole numbers of a few bits each; whole
numbers add up without rounding in any order. Two forms:

* :func:`statistics` for numbers. A value belongs to the bin of its exponent, 20 binary places wide; its parts and
  those of its square are long sums of the bin. A group has a handful of bins, so this is an ordinary aggregation
  with partial sums. At its end there is one row per group, whose bins become mean and deviation in Python integers.
* :class:`VectorSums` for vectors, where a row per component would be too much. The spread of exponents in the
  table is measured once; every component becomes as many limbs as that spread takes.

Not-a-number and infinities do not count in ``statistics`` and make a component of a vector sum not-a-number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from answerlab.functions.vectors import is_finite

# Binary places of a bin; the sums of its parts stay within a long for 2 ** 42 rows.
WIDTH = 20
# Bins of the smallest doubles are one, so that its scale is a double too.
_LOWEST = -51
# A value of a bin has parts of these weights (exponents of WIDTH bits), its square of those.
_VALUE_PARTS = tuple(range(0, -4, -1))
_SQUARE_PARTS = tuple(range(1, -7, -1))
# Splits a double into two halves whose products are exact.
_HALVES = 2.0**27 + 1.0


def _part(x: Column, weight: int, top: int) -> Column:
    """The whole number that stands at a weight; the highest weight takes all above it."""
    scaled = x * F.lit(2.0 ** (-WIDTH * weight))
    return (scaled if weight == top else scaled % F.lit(2.0**WIDTH)).cast("long")


def _summed_parts(x: Column) -> list[Column]:
    """Long sums of the parts of a value of its bin, scaled, and of its square."""
    c = x * _HALVES
    high = c - (c - x)
    low = x - high
    square = x * x
    rest = ((high * high - square) + F.lit(2.0) * high * low) + low * low
    value = [_part(x, w, _VALUE_PARTS[0]) for w in _VALUE_PARTS]
    squares = [_part(square, w, _SQUARE_PARTS[0]) + _part(rest, w, _SQUARE_PARTS[0]) for w in _SQUARE_PARTS]
    return [F.coalesce(F.sum(part), F.lit(0)) for part in value + squares]


def _whole(bins: list) -> tuple[int, int, int, int]:
    """(count, sum, sum of squares, exponent): the sum in units of 2 ** exponent, the other in its square."""
    lowest = min(row[0] for row in bins)
    count = total = squares = 0
    for at, n, *parts in bins:
        up = WIDTH * (at - lowest)
        count += n
        for weight, part in zip(_VALUE_PARTS, parts[:4], strict=True):
            total += part << (up + WIDTH * (weight - _VALUE_PARTS[-1]))
        for weight, part in zip(_SQUARE_PARTS, parts[4:], strict=True):
            squares += part << (2 * up + WIDTH * (weight - _SQUARE_PARTS[-1]))
    return count, total, squares, WIDTH * (lowest + _VALUE_PARTS[-1])


def _to_double(numerator: int, denominator: int, exponent: int) -> float:
    """numerator / denominator * 2 ** exponent, rounded once."""
    up, down = max(exponent, 0), max(-exponent, 0)
    try:
        return (numerator << up) / (denominator << down)
    except OverflowError:
        return math.copysign(math.inf, numerator)


def summary(bins: list) -> tuple[int, float | None, float | None, float | None]:
    """(n, mean, std, limit) of the bins of a group.

    The mean is correctly rounded. The limit is the largest double that is not above the exact mean plus
    the exact deviation, so ``x <= limit`` says whether x is not above that sum.
    """
    bins = [[int(x) for x in row] for row in bins]
    n, total, squares, exponent = _whole(bins)
    if not n:
        return 0, None, None, None
    spread = n * squares - total * total
    mean = _to_double(total, n, exponent)
    # So many binary places of the root that 64 are left where the sum and it cancel.
    more = spread.bit_length() // 2 + 72
    root = math.isqrt(spread << 2 * more)
    std = _to_double(root, n, exponent - more)
    limit = _to_double((total << more) + root, n, exponent - more)

    def above(x: float) -> bool:
        beyond = n * Fraction(x) / Fraction(2) ** exponent - total
        return beyond > 0 and beyond * beyond > spread

    # It is rounded to the nearest, so a step or two away at most.
    while math.isfinite(limit) and above(limit):
        limit = math.nextafter(limit, -math.inf)
    while math.isfinite(higher := math.nextafter(limit, math.inf)) and not above(higher):
        limit = higher
    return n, mean, std, limit


_SUMMARY = "array<struct<n: bigint, mean: double, std: double, limit: double>>"


def _summaries(count: int):
    """The summaries of the values of a group; its rows are (value, bin, count, parts)."""

    def of(rows) -> list[dict]:
        bins: list[list] = [[] for _ in range(count)]
        for row in rows:
            bins[int(row[0])].append(row[1:])
        return [dict(zip(("n", "mean", "std", "limit"), summary(own) if own else (0, None, None, None))) for own in bins]

    @F.pandas_udf(_SUMMARY)
    def summaries(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in groups:
            yield series.map(of)

    return summaries


def statistics(frame: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """A row per group: the keys, and for each value a struct of ``n``, ``mean``, ``std`` and ``limit``.

    ``std`` is that of the population; ``limit`` see :func:`summary`. Null, not-a-number and infinities
    do not count; a group without values has n 0 and nulls. Without keys there is one row, if there is any row.
    """
    number = F.col("_value._x")
    each = F.array(
        *[
            F.struct(F.lit(i).alias("_i"), F.when(is_finite(x.cast("double")), x.cast("double")).alias("_x"))
            for i, x in enumerate(values.values())
        ]
    )
    rows = frame.select(*keys, F.explode(each).alias("_value")).select(*keys, F.col("_value._i").alias("_i"), number.alias("_x"))
    x = F.col("_x")
    exponent = F.floor(F.log2(F.abs(x)) / WIDTH)
    # Zero, and a value that does not count, are nothing in any bin.
    rows = rows.withColumn("_bin", F.when(x != 0, F.greatest(exponent, F.lit(_LOWEST))).otherwise(F.lit(0)).cast("int"))
    scaled = x * F.pow(F.lit(2.0), -WIDTH * F.col("_bin"))
    rows = rows.withColumn("_scaled", scaled)
    sums = rows.groupBy(*keys, "_i", "_bin").agg(
        F.array(F.col("_i").cast("long"), F.col("_bin").cast("long"), F.count("_x"), *_summed_parts(F.col("_scaled"))).alias("_sums")
    )
    groups = sums.groupBy(*keys).agg(F.collect_list("_sums").alias("_sums"))
    groups = groups.withColumn("_all", _summaries(len(values))(F.col("_sums")))
    return groups.where(F.size("_sums") > 0).select(*keys, *[F.col("_all")[i].alias(name) for i, name in enumerate(values)])


@dataclass(frozen=True)
class VectorSums:
    """Means of vectors by limbs of ``width`` bits, the first below 2 ** ``top``.

    Limbs are whole numbers whose sums over all rows of the table stay below 2 ** 53, so adding them as doubles
    is exact. Components beyond 900 binary places below the largest one count as zero.
    """

    top: int
    width: int
    limbs: int
    bytes: int

    @staticmethod
    def measure(frame: DataFrame, vector: str = "v") -> VectorSums:
        """One pass over the vectors: how long they are, how many, and the spread of their exponents."""
        sizes = F.transform(F.filter(vector, lambda x: is_finite(x) & (x != 0)), F.abs)
        found = frame.agg(
            F.max(F.size(vector)).alias("size"),
            F.count(vector).alias("rows"),
            F.max(F.array_max(sizes)).alias("largest"),
            F.min(F.array_min(sizes)).alias("smallest"),
        ).first()
        top = max(math.frexp(found["largest"] or 1.0)[1], -100)
        low = max(math.frexp(found["smallest"] or 1.0)[1] - 53, top - 900)
        # A limb and its offset take width + 1 bits, and the count of rows the rest of 52.
        width = max(1, 51 - found["rows"].bit_length())
        return VectorSums(top, width, -(-(top - low) // width), 8 * max(found["size"] or 0, 0))

    def _limb(self, vector: Column, at: int) -> Column:
        """One limb of every component, made positive."""
        # The factor is split: it need not be a double as a whole.
        up = self.width * (at + 1) - self.top
        half, rest, base = 2.0 ** (up // 2), 2.0 ** (up - up // 2), 2.0**self.width

        def of(x: Column) -> Column:
            limb = ((x * F.lit(half) * F.lit(rest)) % F.lit(base)).cast("long").cast("double")
            return F.when(is_finite(x), limb + F.lit(base)).otherwise(F.lit(float("nan")))

        return F.transform(vector, of)

    def mean(self, vector: Column) -> Column:
        """Aggregate: the mean of the vectors of a group, null for none.

        The sum of magnitudes is the one plain sum of vectors that there is as an aggregate; limbs are not negative here.
        """
        limbs = F.concat(*[self._limb(vector, at) for at in range(self.limbs)])
        sums = vector_to_array(Summarizer.normL1(array_to_vector(limbs)))
        n = F.count(vector).cast("double")
        base = F.lit(2.0**self.width)
        size = (F.size(sums) / self.limbs).cast("int")

        weights = F.array(*[F.lit(2.0 ** (self.top - self.width * (at + 1))) for at in range(self.limbs)])
        nothing = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("carry"))

        def of(i: Column) -> Column:
            # From the lowest limb on. What a limb has above its width is carried before it is added, to the
            # nearest, so that the rest is at most half of the next one and nothing cancels.
            def add(state: Column, at: Column) -> Column:
                own = F.get(sums, size * at + i) - n * base + state["carry"]
                up = F.when(at > 0, F.rint(own / base)).otherwise(F.lit(0.0))
                value = state["value"] + (own - up * base) * F.get(weights, at)
                return F.struct(value.alias("value"), up.alias("carry"))

            places = F.sequence(F.lit(self.limbs - 1), F.lit(0), F.lit(-1))
            return F.aggregate(places, nothing, add, lambda state: state["value"] / n)

        return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), of)).otherwise(F.array().cast("array<double>"))
