"""Exam scoring, grouped accuracies and paired comparison of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.stats import mcnemar, paired_interval, wilson
from lodestream.functions.text import extract_choice, normalized_choice


def first_rows(exam: DataFrame) -> DataFrame:
    """One whole row a non-null id: of repeated ids one with an answer, the least in code-point order."""
    rank = Window.partitionBy("id").orderBy(F.col("answer").asc_nulls_last(), "question", "question_type")
    return exam.where("id is not null").withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def questions(exam: DataFrame) -> DataFrame:
    """One row a non-null id with ``keys``, the letters of its choices, and normalised ``gold``."""
    keys = F.array_join(F.array_sort(F.map_keys("choices")), "")
    return first_rows(exam).select("id", "exam_type", "exam_class", "exam_subject", "question_type", "question", keys.alias("keys"), normalized_choice(F.col("answer"), keys).alias("gold"))


def score(q: DataFrame, predictions: DataFrame) -> DataFrame:
    """``questions`` ⟕ predictions (id, output): answer, method, correct; a missing prediction is a wrong answer with method missing."""
    x = q.join(predictions.select("id", "output", F.lit(True).alias("_has")), "id", "left")
    c = extract_choice(F.col("output"), F.col("keys"), F.col("question_type"))
    x = x.withColumn("_c", c).withColumn("answer", F.when(F.col("_has"), F.col("_c.answer")))
    x = x.withColumn("method", F.when(F.col("_has"), F.col("_c.method")).otherwise("missing"))
    return x.withColumn("correct", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))).drop("_c", "_has", "output")


def accuracies(scored: DataFrame, dims: list[str]) -> DataFrame:
    """``dimension, value, total, correct, accuracy, low, high`` overall and by each dimension, in one pass over grouping sets."""
    sets = ", ".join(["()", *(f"({d})" for d in dims)])
    sql = f"SELECT {', '.join(dims)}, grouping_id({', '.join(dims)}) AS g, count(*) AS total, count_if(correct) AS correct FROM {{t}} GROUP BY GROUPING SETS ({sets})"
    x = scored.sparkSession.sql(sql, t=scored)
    full = (1 << len(dims)) - 1
    name = F.when(F.col("g") == full, "all")
    value = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        on = F.col("g") == full - (1 << (len(dims) - 1 - i))
        name, value = name.when(on, d), F.when(on, F.col(d)).otherwise(value)
    low, high = wilson(F.col("correct"), F.col("total"))
    return x.select(name.alias("dimension"), value.alias("value"), "total", "correct", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def paired_comparison(a: DataFrame, b: DataFrame, margin: float = 0.01) -> DataFrame:
    """One row: n, better, worse, both, delta with its interval, p of McNemar, and whether b is not inferior. Inputs: id, correct."""
    p = a.select("id", F.col("correct").alias("a")).join(b.select("id", F.col("correct").alias("b")), "id")
    x = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") & ~F.col("a")).alias("better"), F.count_if(F.col("a") & ~F.col("b")).alias("worse"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    d, low, high = paired_interval(F.col("better"), F.col("worse"), F.col("n"))
    x = x.select("n", "better", "worse", "both", F.round(d, 6).alias("delta"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
    return x.withColumn("p", F.round(mcnemar("better", "worse"), 8)).withColumn("not_inferior", F.col("low") >= -margin)


def scorecard(runs: DataFrame, base: str, kinds: dict[str, str]) -> DataFrame:
    """``model, correct, total, accuracy, delta_vs_base, macro_accuracy``, accuracy of each kind of question (null where a model has none) and ``invalid_predictions``.

    Columns of ``runs``: model, question_type, exam_class, correct, invalid. macro_accuracy is the mean over classes. An unknown base gives null deltas.
    """
    right = F.count_if("correct")
    of = lambda v: F.try_divide(F.count_if(F.col("correct") & (F.col("question_type") == v)), F.count_if(F.col("question_type") == v))
    n = F.count(F.lit(1))
    a = runs.groupBy("model").agg(right.alias("correct"), n.alias("total"), (right / n).alias("acc"), *[F.round(of(v), 6).alias(k) for k, v in kinds.items()], F.count_if("invalid").alias("invalid_predictions"))
    macro = runs.groupBy("model", "exam_class").agg((F.count_if("correct") / n).alias("acc")).groupBy("model").agg(F.round(F.avg("acc"), 6).alias("macro_accuracy"))
    b = runs.where(F.col("model") == base).agg((F.count_if("correct") / F.nullif(n, F.lit(0))).alias("base"))
    x = a.join(macro, "model").crossJoin(b)  # one row
    return x.select("model", "correct", "total", F.round("acc", 6).alias("accuracy"), F.round(F.col("acc") - F.col("base"), 6).alias("delta_vs_base"), "macro_accuracy", *kinds, "invalid_predictions")
