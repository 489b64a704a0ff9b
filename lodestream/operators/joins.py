"""Joins with checked keys, keyed upserts, resumable anti-joins and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count; null keys count too."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, or an error that names a repeated or null key."""
    bad = df.where(F.coalesce(*[F.col(k).isNull() for k in keys])).limit(1).collect() or repeated_keys(df, *keys).limit(1).collect()
    if bad:
        raise ValueError(f"repeated or missing key {keys}: {bad[0]}")
    return df


def field_mismatches(left: str, right: str, fields: list[str]) -> Column:
    """Codes ``<field>_mismatch`` of the fields in which two joined sides differ, null-safe."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f"{f}_mismatch")) for f in fields]))


def audited_join(rows: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with ``issues``: source_not_found, or the fields in which the row and its source differ.

    ``source`` must have one row a key. A null key finds no source.
    """
    x = rows.alias("l").join(source.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "left")
    issues = F.when(F.col(f"r.{key}").isNull(), F.array(F.lit("source_not_found"))).otherwise(field_mismatches("l", "r", fields))
    return x.select("l.*", issues.alias("issues"))


def pending(requests: DataFrame, done: DataFrame, key: str, ok: Column | None = None) -> DataFrame:
    """Requests whose key has no finished row; the way a batch resumes."""
    finished = (done if ok is None else done.where(ok)).select(key)
    return requests.join(finished, key, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` in which rows with a key of ``changes`` are replaced; keys only in ``changes`` are an error, so counts never change."""
    strange = changes.join(base, key, "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"no row to replace: {strange[0][key]}")
    rest = [c for c in base.columns if c != key]
    new = changes.select(key, F.struct(*rest).alias("_new"))
    x = base.select(key, F.struct(*rest).alias("_old")).join(new, key, "left").select(key, F.coalesce("_new", "_old").alias("_r"))
    return x.select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(*base.columns)


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys on one side only, left or right."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def merge_unique(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of frames by column name, missing columns null; an error if a key occurs in more than one row."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    assert_unique(out, key)
    return out


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides: what leaks between splits."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_semi")
