"""Near-duplicate records, and records shared between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.setjoin import cross_join, representatives, tjoin
from lodestream.llm.textkeys import with_canonical
from lodestream.session import materialize

#: Members of a class of equal texts that one task expands at once.
BLOCK = 2048


def members(df: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """Distinct ``id, ckey, canon`` and extra columns; rows with null id, null text or empty canonical form are left out."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra).where("id is not null")
    return with_canonical(named, ["id", *extra], "text").dropDuplicates(["id", "ckey", *extra])


def in_blocks(m: DataFrame) -> DataFrame:
    """``id, ckey`` and further columns with ``part`` and ``parts``: members of a large class of equal texts in blocks of some BLOCK. Written as a table."""
    size = m.groupBy("ckey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    size = size.select("ckey", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    x = m.join(size, "ckey", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return materialize(x.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "class-blocks")


def _joined(pairs: DataFrame, blocks: DataFrame, key: str, name: str) -> DataFrame:
    """``pairs`` with the columns of the members of the class in ``key``; a row of ``pairs`` meets each block of a large class on its own."""
    large = blocks.where("parts > 1").select(F.col("ckey").alias(key), "parts").distinct()
    p = pairs.join(large, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return p.join(blocks.drop("parts").withColumnsRenamed({"ckey": key, "id": name}), [key, "part"]).drop("part")


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of content keys (and further columns) to pairs of ids ``ia, ib`` with the further columns of both sides, members ``in_blocks``."""
    return _joined(_joined(pairs, left, "ckey_a", "ia"), right, "ckey_b", "ib").drop("ckey_a", "ckey_b")


def equal_pairs(blocks: DataFrame) -> DataFrame:
    """``ia, ib`` (ia < ib) of members ``in_blocks`` with equal texts; two blocks of a large class meet in a task of their own."""
    x = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.select("id", "ckey", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    y = x.select(F.col("id").alias("ib"), "ckey", F.col("part").alias("part_b"), "lo", "hi")
    return x.withColumnRenamed("id", "ia").join(y, ["ckey", "lo", "hi"]).where("ia < ib and (lo = hi or part <> part_b)").select("ia", "ib")


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller id first."""
    p = pairs.where("ia <> ib").select(F.least("ia", "ib").alias("source_id_a"), F.greatest("ia", "ib").alias("source_id_b"))
    return p.distinct()


def near_duplicates(df: DataFrame, id_col: str = "source_id", text_col: str = "case_text", t: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members ``id, ckey``, pairs ``ckey_a, ckey_b, overlap, jaccard`` of different texts).

    Texts equal in canonical form share a ``ckey`` and are compared as one. No link between different texts is lost.
    Null ids, null texts and texts with an empty canonical form take no part; an empty table gives empty results.
    """
    m = materialize(members(df, id_col, text_col), "dup-members")
    return m.select("id", "ckey"), tjoin(representatives(m), t)


def duplicate_pairs(df: DataFrame, t: float = 0.5) -> DataFrame:
    """``source_id_a, source_id_b``: all pairs of source_ids with equal or similar case_text."""
    m, pairs = near_duplicates(df, t=t)
    blocks = in_blocks(m)
    return ordered(expand(pairs.select("ckey_a", "ckey_b"), blocks, blocks).unionByName(equal_pairs(blocks)))


def split_class(split: Column) -> Column:
    """train, validation or test, however the split is spelled; null if it is none of them."""
    s = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return (
        F.when(s.rlike("^tr(ai)?n(ing)?(_?set)?$"), "train")
        .when(s.rlike("^(val(id(ation)?)?|dev(el(opment)?)?)(_?set)?$"), "validation")
        .when(s.rlike("^te?st(ing)?(_?set)?$"), "test")
    )


def split_sides(df: DataFrame) -> DataFrame:
    """``id, ckey, canon, split, source_file`` of the rows in a split."""
    src = df.withColumn("split", split_class(F.col("split"))).where("split is not null")
    return materialize(members(src, "source_id", "case_text", "split", "source_file"), "split-members")


def cross_split(m: DataFrame, t: float = 0.5, band: float = 0.0) -> DataFrame:
    """``eval_id, train_id, split, source_file, jaccard, edits``: evaluation records whose text is, exactly or almost, in train.

    ``edits`` is the edit distance of the canonical texts if it is at most the share ``band`` of the longer one, else null.
    """
    role = m.withColumn("role", F.when(F.col("split") == "train", 2).otherwise(1))
    links = cross_join(representatives(role, roles=True), t, band)
    ev, tr = m.where("split <> 'train'").select("id", "ckey", "split", "source_file"), m.where("split = 'train'").select("id", "ckey").distinct()
    near = links.where("ckey_a <> ckey_b").select("ckey_a", "ckey_b", "jaccard", "edits")
    both = ev.select("ckey").distinct().join(tr.select("ckey").distinct(), "ckey")
    same = both.select(F.col("ckey").alias("ckey_a"), F.col("ckey").alias("ckey_b"), F.lit(1.0).alias("jaccard"), F.lit(0).alias("edits"))
    x = expand(near.unionByName(same), in_blocks(ev), in_blocks(tr))
    return x.select(F.col("ia").alias("eval_id"), F.col("ib").alias("train_id"), "split", "source_file", "jaccard", "edits")


def cross_split_pairs(df: DataFrame, t: float = 0.5) -> DataFrame:
    """``source_id_a, source_id_b`` of which one is in train and the other in validation or test."""
    x = cross_split(split_sides(df), t)
    return ordered(x.select(F.col("eval_id").alias("ia"), F.col("train_id").alias("ib")))
