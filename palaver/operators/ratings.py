"""Statistics of rating studies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def describe(ratings: DataFrame, *by: str, value: str = "score") -> DataFrame:
    v = F.col(value)
    return ratings.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


def pivot_difference(ratings: DataFrame, by: str, corpus: str = "corpus", value: str = "score", first: str = "proposed", second: str = "natural") -> DataFrame:
    out = ratings.groupBy(by).pivot(corpus, [second, first]).agg(F.avg(value))
    return out.withColumn("difference", F.col(first) - F.col(second))


def per_key(ratings: DataFrame, *keys: str) -> DataFrame:
    """How many ratings the keys have: count, mean, deviation and quartiles of those numbers."""
    sizes = ratings.groupBy(*keys).agg(F.count("*").alias("size"))
    q = F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = sizes.agg(F.count("*").alias("count"), F.avg("size").alias("mean"), F.stddev_samp("size").alias("std"), F.min("size").alias("min"), q.alias("q"), F.max("size").alias("max"))
    return out.withColumns({"q25": F.get("q", 0), "q50": F.get("q", 1), "q75": F.get("q", 2)}).drop("q")


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values. The tests of a study are few: one window orders them all."""
    order = Window.orderBy(p)
    rank, m = F.row_number().over(order), F.count("*").over(Window.partitionBy())
    rows = tests.withColumn("_step", (m - rank + 1) * F.col(p))
    adjusted = F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("p_adjusted", adjusted).withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_step")


def non_inferior(difference: Column, error: Column, margin: float = -0.30, z: float = 1.6448536269514722) -> Column:
    """struct(low, high, verdict): the 90 % interval, and whether all of it lies above the margin."""
    low, high = difference - z * error, difference + z * error
    return F.struct(low.alias("low"), high.alias("high"), (low > margin).alias("non_inferior"))


#: Most rows of sums that a fit takes to the driver: participants times the clips that each has rated.
MAX_CELLS = 1_000_000


def mixed_fit(ratings: DataFrame, treated: Column) -> dict[str, float]:
    """Effect of a treatment on scores, with random effects of participants and of their clips, by maximum likelihood.

    ratings: participant, clip, score; treated: boolean. Returns difference, error (its standard
    error), intercept and the three variances. The likelihood needs only the sums of each participant and
    clip, which Spark makes; a study has few of them (MAX_CELLS at most). For given ratios of the
    variances the rest has a closed form, so what is searched is a plane.
    """
    x = F.coalesce(treated.cast("double"), F.lit(0.0))
    sums = ratings.where("score is not null").select("participant", "clip", "score", x.alias("x")).groupBy("participant", "clip").agg(
        F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("score").alias("y"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("score")).alias("xy"), F.sum(F.col("score") * F.col("score")).alias("yy"))
    rows = sums.limit(MAX_CELLS + 1).toPandas()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"a fit takes at most {MAX_CELLS} pairs of participant and clip")
    group = pd.factorize(rows["participant"])[0]
    n, sx, sy = (rows[c].to_numpy(float) for c in ("n", "x", "y"))
    first = np.stack((n, sx, sy), axis=1)  # sums of 1, x and y of each cell
    whole = np.zeros((3, 3))
    for i, j, v in ((0, 0, n), (0, 1, sx), (0, 2, sy), (1, 1, rows["xx"]), (1, 2, rows["xy"]), (2, 2, rows["yy"])):
        whole[i, j] = whole[j, i] = float(np.sum(v))
    size, groups = whole[0, 0], int(group.max(initial=-1)) + 1

    def solve(by_person: float, by_clip: float):
        """Minus twice the log likelihood at these ratios to the residual's variance, and what gives it."""
        shrink = by_clip / (1 + by_clip * n)
        inner = whole - (first * shrink[:, None]).T @ first
        scaled = first / (1 + by_clip * n)[:, None]
        per = np.stack([np.bincount(group, scaled[:, k], groups) for k in range(3)], axis=1)
        ones = np.bincount(group, n / (1 + by_clip * n), groups)
        inner = inner - (per * (by_person / (1 + by_person * ones))[:, None]).T @ per
        beta = np.linalg.solve(inner[:2, :2], inner[:2, 2])
        variance = max((inner[2, 2] - beta @ inner[:2, 2]) / size, 1e-12)
        determinant = np.log1p(by_clip * n).sum() + np.log1p(by_person * ones).sum()
        return size * (math.log(2 * math.pi * variance) + 1) + determinant, beta, variance, inner

    low, high, best = np.full(2, -14.0), np.full(2, 8.0), None
    for _ in range(14):  # a grid around the best point so far, each time a third as wide
        grid = [np.linspace(a, b, 9) for a, b in zip(low, high, strict=True)]
        points = [(solve(math.exp(u) if u > -13.9 else 0.0, math.exp(v) if v > -13.9 else 0.0)[0], u, v) for u in grid[0] for v in grid[1]]
        best = min(points if best is None else [*points, best])
        width = (high - low) / 6
        low, high = np.maximum(-14.0, np.array(best[1:]) - width), np.minimum(8.0, np.array(best[1:]) + width)
    person, clip = (math.exp(u) if u > -13.9 else 0.0 for u in best[1:])
    _, beta, variance, inner = solve(person, clip)
    error = math.sqrt(variance * np.linalg.inv(inner[:2, :2])[1, 1])
    return {"difference": float(beta[1]), "error": error, "intercept": float(beta[0]), "participant": person * variance, "clip": clip * variance, "residual": variance}


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for k in range(1, 500):
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        d = 1 / ((1 + even * d) or tiny)
        c = (1 + even / c) or tiny
        f *= c * d
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / ((1 + odd * d) or tiny)
        c = (1 + odd / c) or tiny
        step = c * d
        f *= step
        if abs(step - 1) < 1e-14:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation r of n pairs."""

    def one(r, n):
        if r is None or n is None or math.isnan(r) or n < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        df = n - 2
        return _incomplete_beta(df / 2, 0.5, 1 - r * r)

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")
