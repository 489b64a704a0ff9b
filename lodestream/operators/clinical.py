"""Double-presented comparisons: winners, scores by model, cluster intervals, and validation of exported pairs."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped_winner(decision: Column, a_label: Column, b_label: Column) -> Column:
    """The label that won; other decisions pass."""
    return F.when(decision == "A_better", a_label).when(decision == "B_better", b_label).otherwise(decision)


def outcome_rates(df: DataFrame, outcome: str, base: str, cand: str) -> DataFrame:
    """One row: rows, comparable (base, cand or tie), wins of either, win rate and net win rate of ``cand`` (null without comparables)."""
    n = lambda v: F.count_if(F.col(outcome) == v)
    x = df.agg(F.count(F.lit(1)).alias("rows"), n(base).alias("base_wins"), n(cand).alias("cand_wins"), n("tie").alias("ties"))
    whole = F.nullif(F.col("base_wins") + F.col("cand_wins") + F.col("ties"), F.lit(0))
    return x.withColumn("win_rate", F.round(F.col("cand_wins") / whole, 6)).withColumn("net_win_rate", F.round((F.col("cand_wins") - F.col("base_wins")) / whole, 6))


def side_scores(df: DataFrame, item: str, scores: str, a_label: str, b_label: str) -> DataFrame:
    """``item, label, dimension, score``: mean over the presentations, mapped from side to label. ``scores`` has maps a and b."""
    sides = F.array(F.struct(F.col(a_label).alias("label"), F.col(f"{scores}.a").alias("s")), F.struct(F.col(b_label).alias("label"), F.col(f"{scores}.b").alias("s")))
    x = df.select(item, F.explode(sides).alias("x")).select(item, "x.label", F.explode("x.s").alias("dimension", "v"))
    return x.groupBy(item, "label", "dimension").agg(F.avg("v").alias("score"))


def mean_deltas(scores: DataFrame, item: str, base: str, cand: str) -> DataFrame:
    """``dimension, items, delta``: mean of cand minus base over the items that have both."""
    p = scores.groupBy(item, "dimension").agg(*[F.max(F.when(F.col("label") == v, F.col("score"))).alias(n) for v, n in ((base, "b"), (cand, "c"))])
    return p.where("b is not null and c is not null").groupBy("dimension").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.col("c") - F.col("b")), 6).alias("delta"))


def cluster_interval(df: DataFrame, cluster: str, value: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """One row: clusters, mean, low, high of a 95 % interval by resampling whole clusters.

    Rows shrink to a sum and a count a cluster first; only these reach the one resampling task.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("k")
        s, n = b["s"].tolist(), b["n"].tolist()
        rng = random.Random(seed)
        means = []
        for _ in range(rounds):
            pick = rng.choices(range(len(s)), k=len(s))
            means.append(sum(s[i] for i in pick) / sum(n[i] for i in pick))
        q = pd.Series(means).quantile([0.025, 0.975]).tolist()
        return pd.DataFrame([(len(s), sum(s) / sum(n), q[0], q[1])], columns=["clusters", "mean", "low", "high"])

    x = c.select(F.col(cluster).cast("string").alias("k"), "s", "n", F.lit(1).alias("one"))
    return x.groupBy("one").applyInPandas(lambda b: run(b), "clusters bigint, mean double, low double, high double")


def export_errors(pairs: DataFrame, weights: dict[str, float], per_source: int = 2, tier_b: float = 0.2, controlled: float = 0.1, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """``split, error`` of an exported selection: repeated pair, source over its cap, shares out of range, source in several splits."""
    n = F.count(F.lit(1))
    err = lambda df, name: df.select("split", F.lit(name).alias("error"))
    twice = pairs.groupBy("split", "pair_id").agg(n.alias("n")).where("n > 1")
    over = pairs.groupBy("split", "source_id").agg(n.alias("n")).where(F.col("n") > per_source)
    s = pairs.groupBy("split").agg(
        F.avg((F.col("pair_type") == "controlled_negative").cast("int")).alias("c"), F.avg((F.col("position") == "a").cast("int")).alias("a"),
        F.try_divide(F.count_if((F.col("tier") == "B") & (F.col("pair_type") != "controlled_negative")), F.count_if(F.col("pair_type") != "controlled_negative")).alias("b"), F.count_if(~F.col("pair_type").isin(*weights)).alias("u"),
    )
    leak = pairs.select("source_id", "split").distinct().groupBy("source_id").agg(n.alias("n"), F.min("split").alias("split")).where("n > 1")
    parts = [err(twice, "repeated_pair"), err(over, "source_over_cap"), err(s.where(F.col("c") > controlled + 0.02), "controlled_share"), err(s.where(~F.col("a").between(low - 0.05, high + 0.05)), "position_share"), err(s.where(F.col("b") > tier_b), "tier_b_share"), err(s.where("u > 0"), "unknown_pair_type"), err(leak, "source_in_several_splits")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def carried_history(df: DataFrame, case: str, turn: str, question: str, answer: str) -> DataFrame:
    """Each turn of a case with ``history``: the questions and answers before it, in order. A case is short by nature."""
    from pyspark.sql import Window

    w = Window.partitionBy(case).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("history", F.collect_list(F.struct(F.col(question).alias("question"), F.col(answer).alias("answer"))).over(w))
