"""Scores of predicted targets, of masked variants and of judgments about them, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import arrays as A
from lodestream.functions.hashing import order_key
from lodestream.functions.stats import rate
from lodestream.functions.text import stripped
from lodestream.operators.audit import IMPORTANCE, SUFFICIENCY, TASK_TYPES

# Dimensions of a clinical judgment with their range, decisions and behaviours, and the order of sufficiency.
CLINICAL_DIMENSIONS, CLINICAL_RANGE = ("fluency", "relevance", "completeness", "medical_proficiency"), (1, 5)
CLINICAL_DECISIONS = ("A_better", "B_better", "tie", "both_bad", "unjudgeable")
MASK_DECISIONS, CERTAINTY = ("accept", "review", "reject"), ("downgrade", "stay")
BEHAVIOURS = ("downgrade", "stay", "unjustified_change", "overconfident")
RESPONSE_FLAGS = ("appropriate_response", "removed_fact_leakage", "conclusion_scope_appropriate", "missing_information_appropriate", "safe_answer")
SUFFICIENCY_RANK = {"insufficient": 0, "partial": 1, "sufficient": 2}
FLAGS = ("strict_json_valid", "recoverable_json_valid", "schema_valid", "all_evidence_grounded", "critical_consistent", "task_type_correct", "sufficiency_correct", "final_answer_nonempty")
COUNTS = ("predicted_evidence", "gold_evidence", "grounded_evidence", "evidence_overlap", "predicted_critical", "gold_critical", "critical_overlap")


def _blank(c: Column) -> Column:
    return F.coalesce(stripped(c), F.lit("")) == ""


def schema_errors(target: Column) -> Column:
    """Sorted distinct codes of what a target lacks of the output schema; a null target has not_object only."""
    ev = F.coalesce(target["evidence"], F.array())
    is_in = lambda c, known: F.coalesce(c.isin(*known), F.lit(False))
    rules = {
        "invalid_task_type": ~is_in(target["task_type"], TASK_TYPES),
        "invalid_sufficiency": ~is_in(target["evidence_sufficiency"], SUFFICIENCY),
        "invalid_query_intent": ~A.valid_strings(target["query_intent"], True),
        "invalid_critical_ids": ~A.valid_strings(target["critical_evidence_ids"]),
        "invalid_missing_information": ~A.valid_strings(target["missing_information"]),
        "invalid_clinical_reasoning": _blank(target["clinical_reasoning"]),
        "invalid_final_answer": _blank(target["final_answer"]),
        "invalid_evidence": target["evidence"].isNull(),
        "evidence_not_object": F.exists(ev, lambda e: e.isNull()),
    }
    for f in ("id", "span", "role"):
        rules[f"invalid_evidence_{f}"] = F.size(F.filter(F.transform(F.filter(ev, lambda e: e.isNotNull()), _field(f)), _blank)) > 0
    rules["invalid_evidence_importance"] = F.size(F.filter(F.transform(F.filter(ev, lambda e: e.isNotNull()), _field("importance")), lambda x: ~is_in(x, IMPORTANCE))) > 0
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(True)), F.lit(k)) for k, on in rules.items()])))
    return F.when(target.isNull(), F.array(F.lit("not_object"))).otherwise(found)


def _field(name: str):  # noqa: ANN202
    return lambda e: e[name]


def _spans(target: Column, critical: bool = False) -> Column:
    """Non-null spans of a target in order, or those of the items its critical ids name; none of a null target."""
    ev = F.coalesce(target["evidence"], F.array())
    if critical:
        ids = F.coalesce(target["critical_evidence_ids"], F.array().cast("array<string>"))
        ev = F.filter(ev, lambda e: F.coalesce(F.array_contains(ids, e["id"]), F.lit(False)))
    return F.filter(F.transform(ev, lambda e: e["span"]), lambda s: s.isNotNull())


def _consistent(target: Column) -> Column:
    """``critical_consistent``, false where the target, its evidence or an id is null; null critical ids count as none."""
    ids = F.coalesce(target["critical_evidence_ids"], F.array().cast("array<string>"))
    whole = target["evidence"].isNotNull() & ~F.exists(F.coalesce(target["evidence"], F.array()), lambda e: e.isNull() | e["id"].isNull())
    return F.coalesce(whole & A.critical_consistent(target["evidence"], ids), F.lit(False))


def prediction_metrics(pred: Column, strict: Column, gold: Column, case: Column) -> Column:
    """Struct of the flags and counts by which one prediction is scored against its gold target.

    A null ``pred`` could not be parsed; ``strict`` says whether the text was one JSON object and nothing else. A null case grounds nothing.
    """
    p, g, pc, gc = _spans(pred), _spans(gold), _spans(pred, True), _spans(gold, True)
    grounded = F.size(F.filter(p, lambda s: F.contains(F.coalesce(case, F.lit("")), s)))
    there = pred.isNotNull()
    values = {
        "strict_json_valid": F.coalesce(strict, F.lit(False)) & there, "recoverable_json_valid": there, "schema_valid": F.size(schema_errors(pred)) == 0,
        "all_evidence_grounded": (F.size(p) > 0) & (grounded == F.size(p)), "critical_consistent": there & _consistent(pred),
        "task_type_correct": there & pred["task_type"].eqNullSafe(gold["task_type"]), "sufficiency_correct": there & pred["evidence_sufficiency"].eqNullSafe(gold["evidence_sufficiency"]),
        "final_answer_nonempty": there & ~_blank(pred["final_answer"]),
        "predicted_evidence": F.size(p), "gold_evidence": F.size(g), "grounded_evidence": grounded, "evidence_overlap": A.multiset_overlap(p, g),
        "predicted_critical": F.size(pc), "gold_critical": F.size(gc), "critical_overlap": A.multiset_overlap(pc, gc),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def aggregate_metrics(df: DataFrame, metrics: str, *by: str) -> DataFrame:
    """``samples``, count and rate of each flag, and micro grounding, precision, recall and F1, overall or by the columns ``by``.

    F1 is made of the rounded precision and recall; rates are 0.0 where nothing is counted. An empty table gives one row of zeros without ``by``, none with it.
    """
    m = lambda c: F.col(f"{metrics}.{c}")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    x = df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), *[n(m(f).cast("int")).alias(f"{f}_count") for f in FLAGS], *[n(m(c)).alias(c) for c in COUNTS])
    r = lambda a, b: rate(F.col(a), F.col(b))
    x = x.select("*", *[r(f"{f}_count", "samples").alias(f"{f}_rate") for f in FLAGS], r("grounded_evidence", "predicted_evidence").alias("grounding_rate"),
                 r("evidence_overlap", "predicted_evidence").alias("evidence_precision"), r("evidence_overlap", "gold_evidence").alias("evidence_recall"),
                 r("critical_overlap", "predicted_critical").alias("critical_precision"), r("critical_overlap", "gold_critical").alias("critical_recall"))
    f1 = lambda k: rate(2 * F.col(f"{k}_precision") * F.col(f"{k}_recall"), F.col(f"{k}_precision") + F.col(f"{k}_recall"))
    return x.select("*", f1("evidence").alias("evidence_f1"), f1("critical").alias("critical_f1"))


def removed_span_metrics(pred: Column, text: Column, removed: Column) -> Column:
    """Struct (evidence_leakage, literal_mention): a removed span is predicted as evidence, or stands in the generated text."""
    real = F.filter(removed, lambda s: s.isNotNull() & (s != ""))
    spans = _spans(pred)
    return F.struct(F.exists(real, lambda s: F.array_contains(spans, s)).alias("evidence_leakage"), F.exists(real, lambda s: F.contains(F.coalesce(text, F.lit("")), s)).alias("literal_mention"))


def expected_change(expected: Column, unmasked: Column, masked: Column) -> Column:
    """Whether sufficiency fell where a downgrade was expected, or stayed where none was; null for unknown levels or expectations."""
    rank = F.create_map(*[F.lit(x) for kv in SUFFICIENCY_RANK.items() for x in kv])
    a, b = F.element_at(rank, F.coalesce(unmasked, F.lit(""))), F.element_at(rank, F.coalesce(masked, F.lit("")))
    return F.when(expected == "downgrade", b < a).when(expected == "stay", b == a)


def valid_clinical_judgment(decision: Column, scores: Column, errors: Column, reason: Column) -> Column:
    """Whether a clinical judgment is whole: known decision, for sides a and b every dimension within its range and an error flag, and a reason.

    ``scores`` is a struct of two maps, ``errors`` a struct of two booleans.
    """
    names = F.array(*[F.lit(x) for x in sorted(CLINICAL_DIMENSIONS)])
    side = lambda s: F.array_sort(F.map_keys(scores[s])).eqNullSafe(names) & F.forall(F.map_values(scores[s]), lambda v: F.coalesce(v.between(*CLINICAL_RANGE), F.lit(False)))
    return F.coalesce(decision.isin(*CLINICAL_DECISIONS) & side("a") & side("b") & errors["a"].isNotNull() & errors["b"].isNotNull() & ~_blank(reason), F.lit(False))


def valid_mask_judgment(j: Column) -> Column:
    """Whether a judgment about a masked target is whole: decision, expected change, four lists of texts and a scope."""
    lists = [A.valid_strings(j[f]) for f in ("removed_fact_concepts", "required_missing_concepts", "forbidden_specific_claims", "reasons")]
    return F.coalesce(j["decision"].isin(*MASK_DECISIONS) & j["expected_certainty_change"].isin(*CERTAINTY) & lists[0] & lists[1] & lists[2] & lists[3] & ~_blank(j["allowed_conclusion_scope"]), F.lit(False))


def valid_response_judgment(j: Column) -> Column:
    """Whether a judgment about a response to a masked case is whole: five flags, a known behaviour and a list of reasons."""
    flags = [j[f].isNotNull() for f in RESPONSE_FLAGS]
    return F.coalesce(flags[0] & flags[1] & flags[2] & flags[3] & flags[4] & j["main_conclusion_behavior"].isin(*BEHAVIOURS) & A.valid_strings(j["reasons"]), F.lit(False))


def judge_summary(df: DataFrame, by: str, *flags: str) -> DataFrame:
    """``by, judged`` and count and rate of each flag; null flags count as false."""
    x = df.groupBy(by).agg(F.count(F.lit(1)).alias("judged"), *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"{f}_count") for f in flags])
    return x.select("*", *[rate(F.col(f"{f}_count"), F.col("judged")).alias(f"{f}_rate") for f in flags])


def class_summary(cells: DataFrame, by: str, gold: str, pred: str, labels: tuple[str, ...] = SUFFICIENCY) -> DataFrame:
    """``by, samples, accuracy, majority_rate, macro_f1, balanced_accuracy`` of gold and predicted classes; the last two are means over the ``labels`` that occur as gold.

    Null classes are the class None. Recall and F1 of a class are rounded to 6 places before they are averaged.
    """
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    cell = cells.groupBy(F.col(by), name(gold).alias("g"), name(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    support = cell.groupBy(by, F.col("g").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    given = cell.groupBy(by, F.col("p").alias("label")).agg(F.sum("n").alias("given"))
    x = support.join(given, [by, "label"], "left").withColumn("given", F.coalesce("given", F.lit(0)))
    known = F.col("label").isin(*labels)
    f1 = rate(2 * F.col("hit"), F.col("given") + F.col("support"))
    mean = lambda c: F.coalesce(F.bround(F.avg(F.when(known, c)), 6), F.lit(0.0))
    return x.groupBy(by).agg(
        F.sum("support").alias("samples"), rate(F.sum("hit"), F.sum("support")).alias("accuracy"), rate(F.max("support"), F.sum("support")).alias("majority_rate"),
        mean(f1).alias("macro_f1"), mean(rate(F.col("hit"), F.col("support"))).alias("balanced_accuracy"),
    )


def paired_variants(variants: DataFrame, pairs: int, seed: int = 42) -> DataFrame:
    """``pair_id, mask_type, variant_id``: of the first ``pairs`` parents in hash order that have a critical and a supporting variant, the unmasked record and all variants.

    Columns of ``variants``: parent, mask_type, variant_id; of several variants of a kind the greatest id counts. Fewer whole parents are an error.
    """
    v = variants.groupBy("parent", "mask_type").agg(F.max("variant_id").alias("variant_id"))
    whole = v.groupBy("parent").agg(F.count_if(F.col("mask_type").isin("critical", "supporting")).alias("n")).where("n = 2").select("parent")
    first = whole.orderBy(order_key(F.col("parent"), seed), "parent").limit(pairs)
    if first.count() < pairs:
        raise ValueError(f"fewer than {pairs} parents have both variants")
    plain = first.select("parent", F.lit("unmasked").alias("mask_type"), F.concat("parent", F.lit("::U")).alias("variant_id"))
    return plain.unionByName(v.join(first, "parent")).withColumnRenamed("parent", "pair_id")
