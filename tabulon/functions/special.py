"""Special functions of probability as column expressions, to about 1e-13: they run inside the JVM, row by row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: Lanczos' coefficients for g = 7
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TINY = 1e-300


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _up_to(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0."""

    def lanczos(y: Column) -> Column:  # of y + 1
        total = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:], 1):
            total = total + c / (y + k)
        t = y + 7.5
        return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)

    return _with(x.cast("double"), lambda v: F.when(v >= 0.5, lanczos(v - 1)).when(v > 0, math.log(math.pi) - F.log(F.sin(math.pi * v)) - lanczos(-v)))


def erfc(x: Column) -> Column:
    """The complement of the error function: a series of positive terms up to 2, a continued fraction beyond."""

    def of(v: Column) -> Column:
        a = F.abs(v)
        series = F.aggregate(_up_to(60), F.struct(a.alias("t"), a.alias("s")), lambda acc, n: F.struct((acc["t"] * 2 * a * a / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * a * a / (2 * n + 1)).alias("s")), lambda acc: acc["s"])
        below = 1 - 2 / math.sqrt(math.pi) * F.exp(-a * a) * series
        fraction = F.aggregate(F.reverse(_up_to(120)), a, lambda acc, n: a + n / (2 * acc))
        beyond = F.exp(-a * a) / (math.sqrt(math.pi) * fraction)
        upper = F.when(a <= 2, below).otherwise(beyond)
        return F.when(v >= 0, upper).otherwise(2 - upper)

    return _with(x.cast("double"), of)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def normal_quantile(p: Column) -> Column:
    """The place with probability p below it, for 0 < p < 1; null elsewhere.  A rough start (Abramowitz and Stegun 26.2.23),
    then Halley's steps."""

    def start(q: Column) -> Column:  # of the smaller tail
        t = F.sqrt(-2 * F.log(q))
        return (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) - t

    def of(v: Column) -> Column:
        tail = F.least(v, 1 - v)

        def step(z: Column, _: Column) -> Column:
            off = (normal_cdf(z) - tail) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
            return z - off / (1 + z * off / 2)

        lower = F.aggregate(_up_to(4), start(tail), step)
        return F.when(v == 0.5, 0.0).when((v > 0) & (v < 1), F.when(v < 0.5, lower).otherwise(-lower))

    return _with(p.cast("double"), of)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction (Lentz), whose number of steps grows
    with the square root of the parameters."""

    def fraction(x: Column, a: Column, b: Column) -> Column:
        def away(v: Column) -> Column:
            return F.when(F.abs(v) < TINY, TINY).otherwise(v)

        d0 = 1 / away(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def half(acc: Column, term: Column) -> Column:
            return _with(F.struct(acc.alias("s"), term.alias("t")), lambda w: _with(F.struct((1 / away(1 + w["t"] * w["s"]["d"])).alias("d"), away(1 + w["t"] / w["s"]["c"]).alias("c"), w["s"]["h"].alias("h")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (n["h"] * n["c"] * n["d"]).alias("h"))))

        def step(acc: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return half(half(acc, even), odd)

        steps = F.sequence(F.lit(1), F.lit(60) + (5 * F.sqrt(F.greatest(a, b))).cast("int"))
        return F.aggregate(steps, start, step, lambda acc: acc["h"])

    def of(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        front = F.exp(v["lg"] + a * F.log(x) + b * F.log1p(-x))
        swapped = x >= (a + 1) / (a + b + 2)
        first = F.when(swapped, F.struct((1 - x).alias("x"), b.alias("a"), a.alias("b"))).otherwise(F.struct(x.alias("x"), a.alias("a"), b.alias("b")))
        part = _with(first, lambda w: front * fraction(w["x"], w["a"], w["b"]) / w["a"])
        return F.when((x < 0) | (x > 1) | (a <= 0) | (b <= 0), None).when(x == 0, 0.0).when(x == 1, 1.0).when(swapped, 1 - part).otherwise(part)

    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    return _with(F.struct(x.alias("x"), a.alias("a"), b.alias("b"), (log_gamma(a + b) - log_gamma(a) - log_gamma(b)).alias("lg")), of)


CLOSED, SURE = 20, 1e-3  # degrees of freedom whose sum is closed, and the p-values from which it loses no digits


def t_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) of Student's t with so many degrees of freedom; null without any.

    A few whole degrees have a closed sum, one minus which keeps twelve digits of all but small p-values; those, and other
    degrees, take the continued fraction.
    """

    def of(v: Column) -> Column:
        t, n = v["t"], v["n"]
        x, odd, terms = n / (n + t * t), n % 2, F.floor(n / 2)
        total = F.lit(1.0)
        for i in range(CLOSED // 2 - 1, 0, -1):
            total = F.when(terms > i, 1 + total * x * (2 * i - 1 + odd) / (2 * i + odd)).otherwise(1.0)
        sine = F.sqrt(t * t / (n + t * t))
        below = F.when(odd == 0, sine * total).otherwise(2 / math.pi * (F.atan(F.abs(t) / F.sqrt(n)) + F.when(terms > 0, sine * F.sqrt(x) * total).otherwise(0.0)))
        closed = F.when((n == F.floor(n)) & (n <= CLOSED) & x.between(1e-6, 1.0), 1 - below)
        return _with(closed, lambda p: F.when(p >= SURE, p).otherwise(incomplete_beta(x, n / 2, F.lit(0.5))))

    return F.when(freedom > 0, _with(F.struct(t.cast("double").alias("t"), freedom.cast("double").alias("n")), of))
