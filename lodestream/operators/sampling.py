"""Deterministic deduplication, ordering, quotas and stratified selection as windows and quota tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.hashing import order_key, stable_number
from lodestream.session import broadcast_within

#: Groups whose quotas are sent to all executors; with more of them they are joined by shuffle.
FEW_GROUPS = 100_000


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``. Aggregates map-side, so copies merge before the shuffle; null keys are a key."""
    rest = [c for c in df.columns if c not in keys]
    names = [f"_o{i}" for i in range(len(order))]
    x = df.withColumns(dict(zip(names, order, strict=True))).groupBy(*keys).agg(F.min(F.struct(*names, *rest)).alias("_r"))
    return x.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order`` (nulls lowest)."""
    rest = [c for c in df.columns if c not in keys]
    names = [f"_o{i}" for i in range(len(order))]
    x = df.withColumns(dict(zip(names, order, strict=True))).groupBy(*keys).agg(F.max(F.struct(*names, *rest)).alias("_r"))
    return x.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def category_cap(df: DataFrame, category: str, key: str, target: int, cap: int, seed: int = 42) -> DataFrame:
    """The first ``target`` rows in hash order of ``key`` of which at most ``cap`` share a category.

    Equal to taking rows greedily: at most the first ``cap`` of each category can be taken, and of those the first
    ``target``. Both limits push down as partial limits.
    """
    x = df.withColumn("_k", order_key(F.col(key), seed))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy("_k"))).where(F.col("_n") <= cap)
    return x.orderBy("_k").limit(target).drop("_k", "_n")


def capped_with_backfill(df: DataFrame, category: str, key: str, target: int, cap: int, seed: int = 42) -> DataFrame:
    """``category_cap``, filled up to ``target`` from the other rows in the hash order of the next seed, without the cap."""
    first = category_cap(df, category, key, target, cap, seed).withColumn("origin", F.lit("capped"))
    missing = max(0, target - first.count())
    rest = df.join(first.select(key), key, "left_anti")
    more = rest.withColumn("_k", order_key(F.col(key), seed + 1)).orderBy("_k").limit(missing).drop("_k").withColumn("origin", F.lit("backfill"))
    return first.unionByName(more)


def round_robin(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``turn`` (place within its group in hash order) and ``group_rank`` (place of its group): the interleaved order."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(stable_number(F.col(key), seed=seed), key))
    groups = df.select(group).distinct().withColumn("_g", order_key(F.col(group), seed))
    ranked = groups.withColumn("group_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_g"))).drop("_g")  # one row a group
    return df.withColumn("turn", turn).join(broadcast_within(ranked, FEW_GROUPS), group)


def top_by_hash(df: DataFrame, group: str, key: str, k: int, *salt: str, seed: int = 42) -> DataFrame:
    """The first ``k`` rows of each group by the stable number of key and salt."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(stable_number(F.col(key), *salt, seed=seed), key))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def remainder_quotas(df: DataFrame, group: str, count: int) -> DataFrame:
    """``group, size, quota``: largest-remainder shares of ``count`` by group size, at most the size; ties go to the smaller key.

    All rows if ``count`` reaches their number. One row a group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    one = Window.partitionBy(F.lit(1))
    x = sizes.withColumn("_all", F.sum("size").over(one)).withColumn("_exact", F.lit(count) * F.col("size") / F.col("_all"))
    x = x.withColumn("_base", F.floor("_exact")).withColumn("_left", F.lit(count) - F.sum("_base").over(one))
    x = x.withColumn("_n", F.row_number().over(one.orderBy(F.desc(F.col("_exact") - F.col("_base")), group)))
    quota = F.when(F.col("_all") <= count, F.col("size")).otherwise(F.least("size", F.col("_base") + (F.col("_n") <= F.col("_left")).cast("bigint")))
    return x.select(group, "size", quota.cast("bigint").alias("quota"))


def weight_quotas(weights: DataFrame, count: int) -> DataFrame:
    """``name, quota`` of weights (name, weight): floors and remainders by (fraction, weight, name), descending."""
    one = Window.partitionBy(F.lit(1))
    x = weights.withColumn("_exact", F.col("weight") * count).withColumn("_base", F.floor(F.col("_exact") + 1e-9))
    x = x.withColumn("_left", F.lit(count) - F.sum("_base").over(one))
    x = x.withColumn("_n", F.row_number().over(one.orderBy(F.desc(F.bround(F.col("_exact") - F.col("_base"), 9)), F.desc("weight"), F.desc("name"))))
    return x.select("name", (F.col("_base") + (F.col("_n") <= F.col("_left")).cast("bigint")).alias("quota"))


def stratified(df: DataFrame, group: str, key: str, count: int, seed: int = 42) -> DataFrame:
    """``count`` rows in proportion to their groups, by hash order within each."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order_key(F.col(key), seed), key))
    q = remainder_quotas(df, group, count).select(F.col(group).alias("_g"), "quota")
    return df.withColumn("_n", n).join(broadcast_within(q, FEW_GROUPS), F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_n") <= F.col("quota")).drop("_n", "_g", "quota")


def weighted_fill(df: DataFrame, group: str, key: str, count: int, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """Rows by quotas of ``weights`` (round half-even, at most the group), the rest by hash; each tagged quota or fill."""
    total = df.count()
    target = total if count <= 0 else min(count, total)
    spec = df.sparkSession.createDataFrame([(g, round(target * w)) for g, w in weights.items()], "g string, quota int")
    n = F.row_number().over(Window.partitionBy(group).orderBy(stable_number(F.col(key), "pick", seed=seed), key))
    x = df.withColumn("_n", n).join(F.broadcast(spec), F.col(group) == F.col("g"), "left")
    x = x.withColumn("how", F.when(F.col("_n") <= F.coalesce("quota", F.lit(0)), "quota").otherwise("fill")).drop("_n", "g", "quota")
    first = x.where("how = 'quota'")
    fill = x.where("how = 'fill'").withColumn("_k", stable_number(F.col(key), "fill", seed=seed)).orderBy("_k", key).limit(max(0, target - first.count())).drop("_k")
    return first.unionByName(fill)


def best_with_worst(df: DataFrame, group: str, key: str, *rank: Column) -> DataFrame:
    """``group, pair_no, best, worst``: the i-th best of a group with its i-th worst; no row with itself, no pair twice."""
    w = Window.partitionBy(group)
    x = df.withColumns({f"_r{i}": r for i, r in enumerate(rank)})
    by = [f"_r{i}" for i in range(len(rank))]
    x = x.withColumn("_up", F.row_number().over(w.orderBy(*[F.desc(c) for c in by], key))).withColumn("_n", F.count(F.lit(1)).over(w))
    a = x.where(F.col("_up") * 2 <= F.col("_n")).select(group, F.col("_up").alias("pair_no"), F.col(key).alias("best"))
    b = x.where(F.col("_up") * 2 > F.col("_n")).select(group, (F.col("_n") - F.col("_up") + 1).alias("pair_no"), F.col(key).alias("worst"))
    return a.join(b, [group, "pair_no"])
