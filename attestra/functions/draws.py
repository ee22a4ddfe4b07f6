"""Random draws as Columns: the same seed and key give the same draw on every engine, task and retry.

Uniform numbers are read off the MD5 of a text that names the draw, so there is no state to carry.  Binomials are exact: by inversion where the mean is
small, else by Hoermann's transformed rejection (BTRS, 1993).
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this mean a binomial is inverted step by step; ``LONGEST`` steps leave out less than 1e-15 of it.
SMALL_MEAN, LONGEST = 10.0, 64
#: Attempts of the rejection; each is accepted with a chance of at least 0.7, so the mode that stands in beyond them has one below 1e-20.
ATTEMPTS = 40


def uniforms(key: Column) -> tuple[Column, Column]:
    """Two numbers strictly between 0 and 1, from 52 bits each of the key's MD5."""
    h = F.md5(key.cast("binary"))
    number = lambda at: (F.conv(F.substring(h, at, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    return number(1), number(14)


def _stirling(k: Column) -> Column:
    """ln k! less the leading part of Stirling's formula in k + 1."""
    small = [math.lgamma(i + 1) - (math.log(math.sqrt(2 * math.pi)) + (i + 0.5) * math.log(i + 1) - (i + 1)) for i in range(10)]
    x = k + 1.0
    return F.when(k < 10, F.get(F.array(*(F.lit(s) for s in small)), k.cast("int"))).otherwise((1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def _inverted(n: Column, p: Column, u: Column) -> Column:
    """The number of outcomes whose probabilities are used up before ``u`` is."""
    start = F.struct(F.lit(0.0).alias("k"), u.alias("u"), F.exp(n * F.log1p(-p)).alias("f"), F.lit(False).alias("done"))

    def step(s: Column, ratio: Column) -> Column:
        on = F.struct((s["k"] + 1.0).alias("k"), (s["u"] - s["f"]).alias("u"), (s["f"] * ratio * (n - s["k"]) / (s["k"] + 1.0)).alias("f"), F.lit(False).alias("done"))
        stop = F.struct(s["k"].alias("k"), s["u"].alias("u"), s["f"].alias("f"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(s["u"] <= s["f"], stop).otherwise(on)

    return F.least(n, F.aggregate(F.array_repeat(p / (1.0 - p), (F.least(n, F.lit(float(LONGEST))) + 1.0).cast("int")), start, step)["k"])


def _accepted(n: Column, p: Column, key: Callable[[Column], Column]) -> Column:
    """The first attempt that transformed rejection accepts; p is at most a half."""
    spread = F.sqrt(n * p * (1.0 - p))

    def search(g: Column) -> Column:
        def judged(t: Column) -> Column:
            k, left = t["k"], n - t["k"]
            bound = (g["at_mode"] + (n + 1.0) * F.log((n - g["mode"] + 1.0) / (left + 1.0)) + (k + 0.5) * F.log(g["ratio"] * (left + 1.0) / (k + 1.0)) - _stirling(k) - _stirling(left))
            fits = ((t["us"] >= 0.07) & (t["v"] <= 0.92 - 4.2 / g["b"])) | (F.log(t["v"] * g["alpha"] / (g["a"] / (t["us"] * t["us"]) + g["b"])) <= bound)
            return F.when((k >= 0.0) & (k <= n), F.when(fits, k))

        def attempt(got: Column, i: Column) -> Column:
            u, v = uniforms(key(i))
            tried = let(u - 0.5, lambda x: let(0.5 - F.abs(x), lambda us: F.struct(
                us.alias("us"), F.floor((2.0 * g["a"] / us + g["b"]) * x + n * p + 0.5).cast("double").alias("k"), v.alias("v"))))
            return F.when(got.isNotNull(), got).otherwise(let(tried, judged))

        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("double"), attempt), g["mode"])

    def constants(b: Column) -> Column:
        mode, ratio = F.floor((n + 1.0) * p).cast("double"), p / (1.0 - p)
        at_mode = (mode + 0.5) * F.log((mode + 1.0) / (ratio * (n - mode + 1.0))) + _stirling(mode) + _stirling(n - mode)
        return F.struct(b.alias("b"), (-0.0873 + 0.0248 * b + 0.01 * p).alias("a"), ((2.83 + 5.1 / b) * spread).alias("alpha"), mode.alias("mode"), ratio.alias("ratio"), at_mode.alias("at_mode"))

    return let(let(1.15 + 2.53 * spread, constants), search)


def binomial(n: Column, p: Column, key: Column) -> Column:
    """A binomial draw of ``n`` (a whole double) with chance ``p``, named by ``key``."""
    numbered = lambda i: F.concat_ws(":", key, i)
    small = lambda q: F.when(n * q < SMALL_MEAN, _inverted(n, q, uniforms(numbered(F.lit(0)))[0])).otherwise(_accepted(n, q, numbered))
    k = let(F.least(p, 1.0 - p), small)
    return F.when((n <= 0.0) | (p <= 0.0), 0.0).when(p >= 1.0, n).when(p > 0.5, n - k).otherwise(k)


def multinomial(n: Column, children: Column, key: Column) -> Column:
    """How many of ``n`` each child gets, in proportion to its ``m``; ``children`` is an array of structs with ``id`` and ``m``.  A chain of binomials."""
    total = F.aggregate(children, F.lit(0.0), lambda s, c: s + c["m"])
    start = F.struct(n.cast("double").alias("n"), total.alias("rest"), F.array().cast("array<double>").alias("counts"))

    def give(s: Column, c: Column) -> Column:
        drawn = let(c["m"] / s["rest"], lambda p: binomial(s["n"], p, F.concat_ws(":", key, c["id"])))
        return let(drawn, lambda k: F.struct((s["n"] - k).alias("n"), (s["rest"] - c["m"]).alias("rest"), F.array_append(s["counts"], k).alias("counts")))

    return F.aggregate(children, start, give)["counts"]
