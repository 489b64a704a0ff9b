"""Rates, intervals and tests over counts, and resampling inside groups."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestream.functions.hashing import digest, head64

Z95 = 1.959963984540054


def rate(n: Column, d: Column, places: int = 6) -> Column:
    """n / d rounded half-even; 0.0 where d is 0."""
    return F.when(d == 0, 0.0).otherwise(F.bround(n / d, places))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval, clamped to 0 and 1; (0, 0) for n = 0."""
    p, z2 = successes / n, Z95 * Z95
    centre, scale = p + z2 / (2 * n), 1 + z2 / n
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


def _binomial(better: int, worse: int) -> float:
    n, k = better + worse, min(better, worse)
    return 1.0 if n == 0 else min(1.0, 2 * math.exp(_log_tail(n, k) - n * math.log(2)))


def _log_tail(n: int, k: int) -> float:
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


@F.pandas_udf(DoubleType())
def mcnemar_exact(better: pd.Series, worse: pd.Series) -> pd.Series:
    """Two-sided exact p over discordant counts."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else _binomial(int(a), int(b)) for a, b in zip(better, worse, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def mcnemar(better: pd.Series, worse: pd.Series) -> pd.Series:
    """Exact up to 1,000 discordant pairs, else the normal approximation with continuity correction."""

    def p(a: float, b: float) -> float | None:
        if pd.isna(a) or pd.isna(b):
            return None
        n = int(a + b)
        return _binomial(int(a), int(b)) if n <= 1000 else math.erfc(max(0.0, abs(a - b) - 1) / math.sqrt(n) / math.sqrt(2))

    return pd.Series([p(a, b) for a, b in zip(better, worse, strict=True)], dtype=float)


def paired_interval(better: Column, worse: Column, n: Column) -> tuple[Column, Column, Column]:
    """(delta, low, high): mean of the paired differences and its 95 % normal interval (sample variance)."""
    delta = (better - worse) / n
    var = (better + worse - n * delta * delta) / (n - 1)
    half = Z95 * F.sqrt(var / n)
    one = n <= 1
    return delta, F.when(one, delta).otherwise(delta - half), F.when(one, delta).otherwise(delta + half)


def classification(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row a gold class: support, precision, recall, f1 (6 places); classes without gold rows do not appear."""
    g, p = F.coalesce(F.col(gold).cast("string"), F.lit("None")), F.coalesce(F.col(pred).cast("string"), F.lit("None"))
    cell = df.groupBy(g.alias("g"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    support = cell.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    given = cell.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("given"))
    x = support.join(given, "label", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    pr, rc = rate(F.col("hit"), F.col("given")), rate(F.col("hit"), F.col("support"))
    return x.select("label", "support", pr.alias("precision"), rc.alias("recall"), rate(2 * F.col("hit"), F.col("given") + F.col("support")).alias("f1"))


def bootstrap(df: DataFrame, group: str, value: str, key: str, rounds: int = 5000, seed: int = 42) -> DataFrame:
    """``group, mean, low, high``: percentile interval of the mean of up to some 10,000 values a group, by seeded resampling.

    Evaluation sets are small by nature; the values of one group form one task. Rows are ordered by ``key`` first, so
    the result does not depend on partitioning. Null values are left out.
    """

    def run(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        v = b.sort_values("k")["v"].tolist()
        rng = random.Random(seed)
        means = sorted(sum(rng.choices(v, k=len(v))) / len(v) for _ in range(rounds))
        at = lambda q: means[int((rounds - 1) * q)] + (means[min(rounds - 1, int((rounds - 1) * q) + 1)] - means[int((rounds - 1) * q)]) * ((rounds - 1) * q % 1)
        return pd.DataFrame([(k[0], sum(v) / len(v), at(0.025), at(0.975))], columns=[group, "mean", "low", "high"])

    src = df.select(F.col(group).alias(group), F.col(value).cast("double").alias("v"), F.col(key).cast("string").alias("k")).where("v is not null")
    kind = src.schema[group].dataType.simpleString()
    return src.groupBy(group).applyInPandas(run, f"{group} {kind}, mean double, low double, high double")


def poisson_bootstrap(df: DataFrame, group: str, value: str, key: str, rounds: int = 200) -> DataFrame:
    """The same interval for any number of rows: each row counts Poisson(1) times in each round, drawn from hashes.

    Sums per round merge map-side, so only ``groups * rounds`` rows are shuffled.
    """
    u = head64(digest(F.col(key), F.col("round"))).cast("double") / float(1 << 64)
    cum, p, times = 0.0, math.exp(-1), F.lit(0)
    for k in range(8):
        cum += p
        times = times + (u >= cum).cast("int")
        p /= k + 1
    x = df.where(F.col(value).isNotNull()).select(group, key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    m = x.withColumn("w", times).groupBy(group, "round").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    return m.groupBy(group).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def unit_vector(col: Column) -> Column:
    """Vector of length 1; a zero vector stays zero."""
    norm = F.greatest(F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    return F.transform(col, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
