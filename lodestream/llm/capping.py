"""Capping records per dominant contributor with mergeable quality histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import materialize

#: A contributor with more than this share of all rows counts as hot; at most 1 / HOT_SHARE contributors can.
HOT_SHARE = 1e-4
#: Limit up to which the leaders of a contributor's cutoff bin, at most ``salts`` times the limit, are ranked in one task; beyond, by ranges.
LEADERS = 10_000


def normalized_id(col: Column) -> Column:
    """Lower case without outer white space (Unicode white space included)."""
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def cap_contributors(
    df: DataFrame,
    contributor: str,
    record_id: str,
    quality: str,
    max_count: int | None = None,
    max_share: float | None = None,
    bins: int = 1000,
    low: float = 0.0,
    high: float = 1.0,
    salts: int = 32,
) -> DataFrame:
    """Flag which records of each contributor stay within its limit.

    Returns ``contributor, record_id, quality, kept`` with one row for each row of ``df``. Within a contributor, records
    rank by quality, highest first (null and NaN last), then by record id, smallest first (null last); the first
    ``limit`` of them are kept, where the limit is ``max_count``, or ``floor(max_share * rows of df)``, or the smaller of
    the two. Rows with a null contributor belong to no one and are kept. Repeated rows count each. An empty table
    gives an empty result. Columns of ``df`` other than the three named ones are dropped.

    1. Histogram per contributor over quality bins: partial sums merge, so no contributor is gathered anywhere.
    2. Cutoff bin: the first bin, from the top, at which the running count reaches the limit.
    3. Rows above the cutoff bin are kept and rows below it are not; only rows of the cutoff bin are ranked, first
       within salted parts of the contributor, then among the at most ``salts * need`` leaders of those parts.
    Cutoffs of hot contributors are broadcast (at most ``1 / HOT_SHARE`` rows by definition), the others joined by
    shuffle, in which the hot rows are spread over random keys.
    """
    if max_count is None and max_share is None:
        raise ValueError("give max_count or max_share")
    q = F.col(quality).cast("double")
    q = F.when(F.isnan(q), None).otherwise(q)
    width = (high - low) / bins
    rows = df.select(
        F.col(contributor).alias("c"),
        F.col(record_id).alias("r"),
        F.col(quality).alias("q0"),
        q.alias("q"),
    ).withColumn(
        "bin",
        F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins), F.floor((F.col("q") - low) / width))).cast("int"), F.lit(-1)),
    )
    rows = materialize(rows, "cap-rows")
    hist = materialize(rows.where("c is not null").groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n")), "cap-hist")
    total = rows.count()
    limit = min(x for x in (max_count, None if max_share is None else int(max_share * total)) if x is not None)
    down = Window.partitionBy("c").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        hist.withColumn("run", F.sum("n").over(down))
        .withColumn("all", F.sum("n").over(Window.partitionBy("c")))
        .where((F.col("all") > limit) & (F.col("run") >= max(limit, 1)) & (F.col("run") - F.col("n") < max(limit, 1)))
        .select("c", F.col("bin").alias("cut"), (F.lit(limit) - F.col("run") + F.col("n")).alias("need"), "all")
    )
    cuts = materialize(cuts, "cap-cuts")
    hot_rows = max(1, int(total * HOT_SHARE))
    hot = cuts.where(F.col("all") > hot_rows).select(F.col("c").alias("hc"), F.col("cut").alias("hcut"), F.col("need").alias("hneed"))
    rest = cuts.where(F.col("all") <= hot_rows).select(F.col("c").alias("key"), F.col("cut").alias("rcut"), F.col("need").alias("rneed"))
    salt = F.pmod(F.xxhash64("r", "q"), F.lit(salts)).cast("int")
    marked = (
        rows.join(F.broadcast(hot), F.col("c") == F.col("hc"), "left")
        .withColumn("key", F.when(F.col("hc").isNull(), F.col("c")).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("r").cast("string"))))
        .join(rest, "key", "left")
        .select("c", "r", "q0", "q", "bin", F.coalesce("hcut", "rcut").alias("cut"), F.coalesce("hneed", "rneed").alias("need"), salt.alias("salt"))
    )
    marked = materialize(marked, "cap-marked")
    order = [F.col("q").desc_nulls_last(), F.col("r").asc_nulls_last()]
    out = ["c", "r", "q0"]
    clear = marked.where(F.col("cut").isNull() | (F.col("bin") != F.col("cut"))).select(
        *out, (F.col("cut").isNull() | ((F.col("bin") > F.col("cut")) & F.lit(limit > 0))).alias("kept")
    )
    border = marked.where(F.col("bin") == F.col("cut")).withColumn("rn", F.row_number().over(Window.partitionBy("c", "salt").orderBy(*order)))
    border = materialize(border.select(*out, "q", "need", "rn"), "cap-border")
    behind = border.where(F.col("rn") > F.col("need")).select(*out, F.lit(False).alias("kept"))
    front = border.where(F.col("rn") <= F.col("need"))
    if limit <= LEADERS:
        front = front.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(*order)))
    else:
        front = _placed(front, order)
    front = front.select(*out, (F.col("place") <= F.col("need")).alias("kept"))
    res = clear.unionByName(behind).unionByName(front)
    return res.select(F.col("c").alias(contributor), F.col("r").alias(record_id), F.col("q0").alias(quality), "kept")


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with the ``place`` of each row within its ``c``, for contributors too large for one task.

    Rows are sorted by range over all tasks; a row's place is its place in its own range and the contributor's rows in the ranges before.
    """
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = materialize(df.repartitionByRange(parts, F.col("c"), *order).withColumn("part", F.spark_partition_id()), "cap-ranges")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = x.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    own = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))
    return x.join(n, ["c", "part"]).withColumn("place", F.col("skip") + own)


def usable_judgments(judgment: DataFrame) -> DataFrame:
    """``pair_id, contributor, confidence`` of the rows that count, one for each pair_id.

    A row counts if its status is ok and its confidence lies in 0 to 1; of several rows of a pair the latest created_at
    counts (null last), then the latest loaded_at, then the higher confidence, then the greater source_id. Rows with a
    null pair_id name no pair and are dropped.
    """
    j = judgment.select(
        "pair_id", normalized_id(F.col("source_id")).alias("contributor"), "created_at", "loaded_at",
        F.col("parsed_judgment.confidence").cast("double").alias("confidence"), "status",
    ).where((F.col("status") == "ok") & F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence") & F.col("pair_id").isNotNull())
    last = F.max(F.struct("created_at", "loaded_at", "confidence", "contributor")).alias("x")
    return j.groupBy("pair_id").agg(last).select("pair_id", "x.contributor", "x.confidence")
