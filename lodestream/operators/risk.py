"""Numbers and certainty claims in generated text that its case does not support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.text import MEDICAL_UNITS, measures_in

# Claims of certainty, what hedges or resolves them, and what supports them in the span.
STRONG_ROLE = "排除|证实|证明|确定|明确不是|因此一定是"
HEDGED_PREFIX = "不能|无法|尚不能|未能|未被|不支持|不足|仅|提示|倾向|考虑|需|需要|有助于|用于|以便|支持|优先|进一步|(?:^|[^未])未$|不$"
NONCLINICAL = "确定性|确定.{0,12}(?:时间|日期|月份|病程|疗程|方向|方案|治疗|处理|检查|复查|随访|用药|剂量|范围|顺序|类型|性质|部位|需求|必要性|孕周)"
RESOLVED = "可能排除|提示.{0,40}排除|需.{0,40}排除|说明.{0,40}排除|提供.{0,40}排除|可(?:初步|辅助)?排除|有助于排除|支持排除|是排除"
DIRECT_DIAGNOSIS = "诊断|确诊|检查.{0,16}(?:说|显示|提示|发现|是)|病理|影像.{0,8}(?:显示|提示)"
NEGATIVE_FINDING = "无|未见|没有|阴性|正常|未发现|排除"
CLAUSE_END = "[，；。,:：;]"
HIGH_RISK_WARNINGS = ("task_type_changed_by_teacher", "strong_role_claim_requires_review", "generated_numbers_require_review")


def number_risk(case: Column, text: Column) -> Column:
    """Struct (high, medium) of sorted labels of the numbers in ``text`` that ``case`` lacks; null texts count as empty.

    A number with a unit is supported by the same number in the case, whatever its unit; one without by the same label. Numbers of
    a list's items are passed over. High are the units of medical parameters, medium all others.
    """
    known = measures_in(F.coalesce(case, F.lit("")))
    keys, labels = F.transform(known, lambda m: m["key"]), F.transform(known, lambda m: m["label"])
    new = F.filter(measures_in(F.coalesce(text, F.lit(""))), lambda m: ~m["listed"] & F.when(m["unit"] != "", ~F.array_contains(keys, m["key"])).otherwise(~F.array_contains(labels, m["label"])))
    of = lambda on: F.array_sort(F.array_distinct(F.transform(F.filter(new, on), lambda m: m["label"])))
    medical = lambda m: m["unit"].isin(*MEDICAL_UNITS)
    return F.struct(of(medical).alias("high"), of(lambda m: ~medical(m)).alias("medium"))


def role_risk(span: Column, role: Column) -> Column:
    """clean, medium or high: whether the role of an evidence item claims more certainty than its span carries.

    A claim counts unless its own clause hedges it before. Null spans and roles are clean.
    """
    # each piece but the last is followed by a claim; what hedges it must stand in its last clause
    before = F.slice(F.split(role, STRONG_ROLE), F.lit(1), F.greatest(F.size(F.split(role, STRONG_ROLE)) - 1, F.lit(0)))
    claims = F.regexp_extract_all(role, F.lit(f"({STRONG_ROLE})"), 1)
    # claims themselves stand in the clause as well, so a clause is rebuilt from pieces and claims
    woven = F.transform(before, lambda x, i: F.array_join(F.flatten(F.zip_with(F.slice(before, F.lit(1), i), F.slice(claims, F.lit(1), i), lambda p, c: F.array(p, c))), ""))
    clauses = F.zip_with(woven, before, lambda w, x: F.element_at(F.split(F.concat(w, x), CLAUSE_END), -1))
    unhedged = F.exists(clauses, lambda c: ~c.rlike(HEDGED_PREFIX))
    clean = ~unhedged | role.rlike(NONCLINICAL) | role.rlike(RESOLVED) | (span.rlike(DIRECT_DIAGNOSIS) & role.rlike("诊断|确诊")) | F.contains(span, F.lit("排除"))
    level = F.when(clean, "clean").when(span.rlike(NEGATIVE_FINDING) | span.rlike("没|不是"), "medium").otherwise("high")
    return F.coalesce(F.when(span.isNotNull() & role.isNotNull(), level), F.lit("clean"))


def target_risk(case: Column, target: Column, warnings: Column) -> Column:
    """Struct (level, reasons, high_ids, medium_ids, high_numbers, medium_numbers): how risky a target is beyond its warning codes.

    Levels are clean, low, medium and high. Null warnings count as none, null ids as unknown.
    """
    none = F.array().cast("array<string>")
    codes = F.transform(F.coalesce(warnings, none), lambda w: F.substring_index(w, ":", 1))
    items = F.coalesce(target["evidence"], F.array())
    of = lambda level: F.transform(F.filter(items, lambda e: role_risk(e["span"], e["role"]) == level), lambda e: F.coalesce(e["id"], F.lit("unknown")))
    high_ids, medium_ids = of("high"), of("medium")
    written = target["clinical_reasoning"].isNotNull() & target["final_answer"].isNotNull()
    n = number_risk(case, F.concat(target["clinical_reasoning"], F.lit("\n"), target["final_answer"]))
    high_numbers, medium_numbers = F.when(written, n["high"]).otherwise(none), F.when(written, n["medium"]).otherwise(none)
    some = lambda c: F.size(c) > 0
    coded = lambda name: F.array_contains(codes, name)
    named = lambda code, c: F.concat(F.lit(code + ":"), F.array_join(c, ","))
    rules = (
        (coded("task_type_changed_by_teacher"), 1, F.lit("teacher_task_type_correction_audit_only")),
        (some(high_ids), 3, named("unsupported_unhedged_strong_role", high_ids)),
        (some(medium_ids), 2, named("context_supported_strong_role_requires_review", medium_ids)),
        (~some(medium_ids) & ~some(high_ids) & coded("strong_role_claim_requires_review"), 1, F.lit("strong_role_warning_resolved_by_context")),
        (some(high_numbers), 3, named("unsupported_medical_parameter", F.slice(high_numbers, 1, 8))),
        (some(medium_numbers), 2, named("unsupported_time_or_unitless_number", F.slice(medium_numbers, 1, 8))),
        (coded("generated_numbers_require_review") & ~some(high_numbers) & ~some(medium_numbers), 1, F.lit("generated_number_warning_resolved_as_enumeration")),
    )
    rank = F.greatest(F.lit(0), *[F.when(on, r).otherwise(0) for on, r, _ in rules])
    level = F.element_at(F.array(*[F.lit(x) for x in ("clean", "low", "medium", "high")]), rank + 1)
    reasons = F.array_compact(F.array(*[F.when(on, why) for on, _, why in rules]))
    return F.struct(level.alias("level"), reasons.alias("reasons"), high_ids.alias("high_ids"), medium_ids.alias("medium_ids"), high_numbers.alias("high_numbers"), medium_numbers.alias("medium_numbers"))


def has_high_risk_warning(warnings: Column) -> Column:
    """Whether a warning is of a kind that vetoes a target under the strict policy."""
    return F.coalesce(F.exists(warnings, lambda w: w.rlike("^(?:" + "|".join(HIGH_RISK_WARNINGS) + ")")), F.lit(False))
