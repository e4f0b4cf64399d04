"""Statistics as column expressions that never raise on constant input."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from examlens.functions.common import hash32, once


def pearson(first: Column, second: Column) -> Column:
    """Pearson r as an aggregate; null when a side is constant (``corr`` would raise)."""
    return F.try_divide(
        F.covar_pop(first, second), F.stddev_pop(first) * F.stddev_pop(second)
    )


# Distributed sums differ in the last bits from run to run; ranks must not depend on that, so
# values that agree to this many digits are ties.
RANK_DIGITS = 9


def average_rank(value: str, partition: list[str]) -> Column:
    """Rank within a partition where ties share the mean of their positions."""
    rounded = F.round(value, RANK_DIGITS)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, rounded))
    return F.rank().over(Window.partitionBy(*partition).orderBy(rounded)) + (ties - 1) / 2


def two_sided_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation, from the t distribution with n - 2 df.

    For integer degrees of freedom the distribution function is a finite trigonometric sum
    (Abramowitz and Stegun 26.7.3 and 26.7.4), folded here over a sequence.
    """
    df = (n - 2).cast("int")
    # theta = atan(t / sqrt(df)) with t = r sqrt(df / (1 - r^2)), so sin(theta) = |r|
    sine = F.abs(r)
    square = 1 - r * r
    odd = (df % 2) == 1
    # successive terms: cos^2 * 2j/(2j+1) when df is odd, cos^2 * (2j-1)/(2j) when even
    terms = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    start = F.when(odd, F.sqrt(square)).otherwise(F.lit(1.0))

    def step(state: Column, j: Column) -> Column:
        factor = F.when(odd, 2.0 * j / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
        term = state["term"] * factor * square
        return F.struct(
            term.alias("term"), (state["total"] + term).alias("total")
        )

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(
        F.array().cast("array<int>")
    )
    series = F.aggregate(
        steps, F.struct(start.alias("term"), start.alias("total")), step, lambda s: s["total"]
    )
    odd_mass = (2 / math.pi) * (
        F.asin(sine) + F.when(df > 1, sine * series).otherwise(F.lit(0.0))
    )
    mass = F.when(odd, odd_mass).otherwise(sine * series)
    return F.when(df >= 1, 1 - mass)


def hashed_uniform(*parts: Column) -> Column:
    """A number between 0 and 1, never either, from the hash that any engine computes alike."""
    return (hash32(*parts).cast("double") + 0.5) / float(2**32)


# Rational approximation of the normal quantile (Acklam), relative error 1.2e-9
_CENTRE = (
    [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239],
    [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0],
)
_TAIL = (
    [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783],
    [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0],
)
_TAIL_BEGINS = 0.02425


def normal_quantile(uniform: Column) -> Column:
    """Quantile of the standard normal distribution, for 0 < ``uniform`` < 1."""

    def ratio(x: Column, parts: tuple[list[float], list[float]]) -> Column:
        above, below = F.lit(0.0), F.lit(0.0)
        for c in parts[0]:
            above = above * x + c
        for c in parts[1]:
            below = below * x + c
        return above / below

    def central(u: Column) -> Column:
        return once(u - 0.5, lambda q: q * once(q * q, lambda r: ratio(r, _CENTRE)))

    def tail(u: Column) -> Column:
        return once(F.sqrt(-2 * F.log(u)), lambda q: ratio(q, _TAIL))

    return F.when(uniform < _TAIL_BEGINS, tail(uniform)).when(uniform > 1 - _TAIL_BEGINS, -tail(1 - uniform)).otherwise(central(uniform))


def _stirling_peak(n: Column, k: Column) -> Column:
    """Binomial probability of ``k`` of ``n`` at chance k / n, for large counts."""

    def error(x: Column) -> Column:
        return 1 / (12 * x) - 1 / (360 * x * x * x)

    return F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(error(n) - error(k) - error(n - k))


def _off_peak(n: Column, k: Column, chance: Column) -> Column:
    """Probability of ``k`` of ``n`` at ``chance``, as a share of that at chance k / n."""
    return once(chance - k / n, lambda d: F.exp(k * F.log1p(d * n / k) + (n - k) * F.log1p(-d * n / (n - k))))


#: Points at which a tail of the beta integral is taken, and how far it reaches, in its deviations.
TAIL_POINTS, TAIL_REACH = 40, 9.5


def _binomial_cdf(n: Column, k: Column, p: Column) -> Column:
    """Probability of at most ``k`` successes, for large counts: n times the integral, from
    ``p`` to 1, of the probability of ``k`` among n - 1. The tail beside the peak is integrated."""
    points = F.array(
        *[F.struct(F.lit((1 + float(x)) / 2).alias("x"), F.lit(float(w) / 2).alias("w")) for x, w in zip(*np.polynomial.legendre.leggauss(TAIL_POINTS))]
    )
    peak = k / (n - 1)
    reach = TAIL_REACH * F.sqrt(peak * (1 - peak) / (n - 1))
    end = F.when(p >= peak, F.least(peak + reach, F.lit(1.0))).otherwise(F.greatest(peak - reach, F.lit(0.0)))
    span = F.struct((n - 1).alias("n"), k.alias("k"), p.alias("p"), (end - p).alias("length"), (p >= peak).alias("above"))

    def integral(s: Column) -> Column:
        def add(total: Column, at: Column) -> Column:
            return total + at["w"] * _off_peak(s["n"], s["k"], s["p"] + at["x"] * s["length"])

        tail = (s["n"] + 1) * _stirling_peak(s["n"], s["k"]) * s["length"] * F.aggregate(points, F.lit(0.0), add)
        return F.when(s["above"], tail).otherwise(1 + tail)

    return once(span, integral)


#: Variance from which a quantile is looked for near its approximation, and how near.
NEAR_VARIANCE, NEAR = 400.0, 4


def _near_quantile(trials: Column, chance: Column, uniform: Column) -> Column:
    """The quantile of a binomial of large variance if it is near where its skewness puts it, else null.

    The distribution function is computed below that place and summed from there: a set number of
    steps, however many trials.
    """

    def placed(b: Column) -> Column:
        sd = F.sqrt(b["n"] * b["p"] * (1 - b["p"]))
        guess = b["n"] * b["p"] + sd * b["z"] + (1 - 2 * b["p"]) * (b["z"] * b["z"] - 1) / 6
        return once(
            F.struct(b["n"].alias("n"), b["p"].alias("p"), b["u"].alias("u"), (F.floor(guess) - NEAR).cast("double").alias("low")),
            search,
        )

    def search(b: Column) -> Column:
        odds = b["p"] / (1 - b["p"])

        def step(s: Column, i: Column) -> Column:
            k = b["low"] + i
            upto = s["t"] + s["w"]
            passed = F.when(upto <= b["u"], s["c"] + 1).otherwise(s["c"])
            return F.struct((s["w"] * (b["n"] - k) / (k + 1) * odds).alias("w"), upto.alias("t"), passed.alias("c"))

        below = _binomial_cdf(b["n"], b["low"] - 1, b["p"])
        at_low = _stirling_peak(b["n"], b["low"]) * _off_peak(b["n"], b["low"], b["p"])

        def count(t: Column) -> Column:
            start = F.struct(at_low.alias("w"), t.alias("t"), F.lit(0).alias("c"))
            steps = F.array(*[F.lit(float(i)) for i in range(2 * NEAR + 2)])
            passed = F.aggregate(steps, start, step, lambda s: s["c"])
            return F.when(
                t <= b["u"], once(passed, lambda c: F.when(c < 2 * NEAR + 2, (b["low"] + c).cast("bigint")))
            )

        return once(below, count)

    known = F.struct(trials.cast("double").alias("n"), chance.alias("p"), uniform.alias("u"), normal_quantile(uniform).alias("z"))
    return once(known, placed)


#: How far from its mean a binomial is looked at: standard deviations, and steps more. What lies
#: beyond is less than the distance of two hashed uniforms.
REACH, MARGIN = 6.5, 8


def binomial_quantile(trials: Column, chance: Column, uniform: Column) -> Column:
    """Least number of successes whose distribution function exceeds ``uniform``.

    A binomial of large variance is searched near its approximation, in a set number of steps.
    Else probabilities follow from their neighbours' ratio, within ``REACH`` standard deviations
    of the mean. Where that begins at zero successes the first probability is known; elsewhere
    all are summed first. ``chance`` lies strictly between 0 and 1.
    """

    def found(b: Column) -> Column:
        ks = F.when(b["high"] > b["low"], F.sequence(b["low"], b["high"] - 1)).otherwise(F.array().cast("array<bigint>"))

        def next_weight(s: Column, k: Column) -> Column:
            return s["w"] * (b["n"] - k).cast("double") / (k + 1).cast("double") * b["odds"]

        # w: probability of k successes, t: of fewer, both in units of the first
        def add(s: Column, k: Column) -> Column:
            return F.struct(next_weight(s, k).alias("w"), (s["t"] + s["w"]).alias("t"))

        first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))
        summed = F.aggregate(ks, first, add, lambda s: s["t"] + s["w"])
        total = F.when(b["low"] == 0, F.pow(1 - b["p"], -b["n"])).otherwise(summed)

        def pass_by(target: Column) -> Column:
            def step(s: Column, k: Column) -> Column:
                upto = s["t"] + s["w"]
                passed = F.when(upto <= target, s["c"] + 1).otherwise(s["c"])
                return F.struct(next_weight(s, k).alias("w"), upto.alias("t"), passed.alias("c"))

            counted = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("c"))
            return F.aggregate(ks, counted, step, lambda s: s["c"])

        return b["low"] + once(b["u"] * total, pass_by)

    mean = trials * chance
    reach = REACH * F.sqrt(mean * (1 - chance)) + MARGIN
    bounds = F.struct(
        trials.alias("n"),
        chance.alias("p"),
        (chance / (1 - chance)).alias("odds"),
        uniform.alias("u"),
        F.greatest(F.floor(mean - reach), F.lit(0)).cast("bigint").alias("low"),
        F.least(F.ceil(mean + reach), trials).cast("bigint").alias("high"),
    )

    def search(b: Column) -> Column:
        large = b["n"] * b["p"] * (1 - b["p"]) >= NEAR_VARIANCE
        return F.coalesce(F.when(large, _near_quantile(b["n"], b["p"], b["u"])), found(b))

    return once(bounds, search)
