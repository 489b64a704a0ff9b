"""Audits of structured targets against their case: rules by severity, routing and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import arrays as A
from lodestream.functions import text as T
from lodestream.operators.risk import STRONG_ROLE

# Allowed values and limits of the target schema.
TASK_TYPES = ("diagnostic_reasoning", "confirmed_management")
SUFFICIENCY = ("sufficient", "partial", "insufficient", "conflicting")
IMPORTANCE = ("critical", "supporting")
MAX_MISSING, MAX_EVIDENCE, LONG_SPAN, SHORT_REASONING, SHORT_ANSWER, SHORT_ROLE = 5, 8, 40, 20, 30, 4


def _flags(rules: dict[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))


def _length(c: Column) -> Column:
    return F.coalesce(F.length(T.stripped(c)), F.lit(0))


def _repeats(c: Column) -> Column:
    return F.size(F.array_distinct(c)) < F.size(c)


def target_issues(case: Column, target: Column, original: Column | None = None) -> tuple[Column, Column, Column]:
    """(errors, review, warnings): sorted codes of a typed target.

    Every rule is one expression, so the audit is a projection. A null target has the single error target_missing; a null case
    finds no span. Null items of lists are invalid items; a list with an invalid item counts as empty in all other rules. Rules on
    spans look at spans that occur in the case.
    """
    none, body = F.array().cast("array<string>"), F.coalesce(case, F.lit(""))
    ev = F.filter(F.coalesce(target["evidence"], F.array()), lambda e: e.isNotNull())
    any_ = lambda f: F.exists(ev, f)
    real = lambda s: s.isNotNull() & (s != "")
    has_id = lambda e: _length(e["id"]) > 0
    inside = lambda e: real(e["span"]) & F.contains(body, e["span"])
    rated = lambda e: F.coalesce(e["importance"].isin(*IMPORTANCE), F.lit(False))
    ids = F.transform(F.filter(ev, has_id), lambda e: e["id"])
    spans = F.transform(F.filter(ev, inside), lambda e: e["span"])
    sound = F.filter(ev, lambda e: has_id(e) & inside(e) & rated(e) & (_length(e["role"]) >= SHORT_ROLE))
    lists = {f: F.when(A.valid_strings(target[f]), F.transform(target[f], T.stripped)).otherwise(none) for f in ("query_intent", "missing_information", "critical_evidence_ids")}
    intent, missing, critical = lists.values()
    marked = F.transform(F.filter(ev, lambda e: (e["importance"] == "critical") & e["id"].isNotNull()), lambda e: e["id"])
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    count = F.size(F.coalesce(target["evidence"], F.array()))
    level = F.coalesce(target["evidence_sufficiency"], F.lit(""))
    errors = {
        "invalid_task_type": ~F.coalesce(target["task_type"].isin(*TASK_TYPES), F.lit(False)),
        "invalid_evidence_sufficiency": ~level.isin(*SUFFICIENCY),
        "query_intent_empty": F.coalesce(F.size(target["query_intent"]) == 0, F.lit(False)),
        **{f"{f}_not_list": target[f].isNull() for f in (*lists, "evidence")},
        **{f"{f}_contains_invalid_item": target[f].isNotNull() & ~A.valid_strings(target[f]) for f in lists},
        "duplicate_critical_evidence_id": _repeats(critical),
        "clinical_reasoning_too_short": _length(target["clinical_reasoning"]) < SHORT_REASONING,
        "final_answer_too_short": _length(target["final_answer"]) < SHORT_ANSWER,
        "evidence_item_not_object": F.exists(F.coalesce(target["evidence"], F.array()), lambda e: e.isNull()),
        "evidence_id_missing": any_(lambda e: ~has_id(e)),
        "evidence_span_missing": any_(lambda e: ~real(e["span"])),
        "evidence_span_not_in_case": any_(lambda e: real(e["span"]) & ~F.contains(body, e["span"])),
        "invalid_evidence_importance": any_(lambda e: ~rated(e)),
        "evidence_role_too_short": any_(lambda e: _length(e["role"]) < SHORT_ROLE),
        "duplicate_evidence_id": _repeats(ids),
        "duplicate_evidence_span": _repeats(spans),
        "sufficient_without_evidence": (level == "sufficient") & (count == 0),
        "partial_without_evidence": (level == "partial") & (count == 0),
        "conflicting_without_multiple_evidence": (level == "conflicting") & (count < 2),
        "critical_evidence_id_not_found": F.size(F.array_except(critical, ids)) > 0,
        "critical_importance_mismatch": as_set(critical) != as_set(marked),
    }
    if original is not None:
        errors["final_answer_copies_original"] = F.coalesce((_length(original) > 0) & (T.canonical(target["final_answer"]) == T.canonical(original)), F.lit(False))
    at = F.transform(sound, lambda e: F.struct((F.position(e["span"], body) - 1).alias("span_start"), (F.position(e["span"], body) - 1 + F.length(e["span"])).alias("span_end")))
    review = {
        "duplicate_query_intent": _repeats(intent),
        "duplicate_missing_information": _repeats(missing),
        "noncanonical_evidence_id": F.exists(ids, lambda i: ~i.rlike(r"^E[1-9]\d*\z")),
        "ambiguous_repeated_evidence_span": F.exists(spans, lambda x: T.occurrences(body, x) > 1),
        "evidence_span_too_short": F.exists(spans, lambda x: F.length(x) == 1),
        "long_evidence_span_requires_atomicity_review": F.exists(spans, lambda x: F.length(x) > LONG_SPAN),
        "query_like_evidence_span": F.exists(spans, lambda x: x.rlike(T.QUERY_LIKE)),
        "nonsequential_evidence_ids": F.exists(F.transform(ids, lambda i, n: i != F.concat(F.lit("E"), (n + 1).cast("string"))), lambda x: x),
        "overlapping_evidence_spans": A.overlapping(at),
        "partial_without_missing_information": (level == "partial") & (F.size(missing) == 0),
        "insufficient_without_missing_information": (level == "insufficient") & (F.size(missing) == 0),
    }
    written = F.concat(target["clinical_reasoning"], F.lit("\n"), target["final_answer"])
    new = F.array_sort(F.array_distinct(F.array_except(T.numbers_in(written), T.numbers_in(body))))
    warnings = {
        "too_many_missing_information_items": F.size(missing) > MAX_MISSING,
        "too_many_evidence_items": count > MAX_EVIDENCE,
        "strong_role_claim_requires_review": any_(lambda e: (_length(e["role"]) >= SHORT_ROLE) & e["role"].rlike(STRONG_ROLE)),
    }
    numbers = F.when(written.isNotNull() & (F.size(new) > 0), F.array(F.concat(F.lit("generated_numbers_require_review:"), F.array_join(F.slice(new, 1, 8), ",")))).otherwise(none)
    gone = target.isNull()
    return (
        F.when(gone, F.array(F.lit("target_missing"))).otherwise(_flags(errors)),
        F.when(gone, none).otherwise(_flags(review)),
        F.when(gone, none).otherwise(F.array_sort(F.concat(_flags(warnings), numbers))),
    )


def audit(audited: DataFrame, candidate: DataFrame, copies: bool = True) -> DataFrame:
    """``source_id, split, category, teacher_model, prompt_version, target, case_text, errors, review, warnings, status`` of each target row against its candidate.

    Whole rows that are repeated count once. Errors of the record: source_id_missing, duplicate_source_id (all copies are rejected),
    source_id_not_in_candidates, case_text_missing, invalid_split, teacher_model_missing, candidate_split_mismatch; a category
    that differs from the candidate's and a task type that differs from its hint are warnings. Any error rejects, else any
    review point sends to review, else the row is accepted. Of a repeated candidate the row loaded first counts. Without ``copies`` answers are not
    compared with the original ones.
    """
    first = F.min(F.struct("loaded_at", "source_file", "source_line", "case_text", "original_answer", "split", "category", "task_type_hint")).alias("c")
    src = candidate.where("source_id is not null").groupBy("source_id").agg(first)
    cols = ["source_id", "split", "category", "teacher_model", "prompt_version", "target"]
    rows = audited.select(*cols).distinct()
    times = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 and source_id is not null")
    x = rows.join(src, "source_id", "left").join(times, "source_id", "left")
    case = F.when(_length(F.col("c.case_text")) > 0, F.col("c.case_text"))
    e, r, w = target_issues(case, F.col("target"), F.col("c.original_answer") if copies else None)
    known = F.col("c").isNotNull()
    own = {
        "source_id_missing": F.coalesce(F.col("source_id"), F.lit("")) == "", "duplicate_source_id": F.col("times").isNotNull(), "source_id_not_in_candidates": ~known,
        "case_text_missing": known & case.isNull(), "invalid_split": ~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)),
        "teacher_model_missing": F.coalesce(F.col("teacher_model"), F.lit("")) == "", "candidate_split_mismatch": known & ~F.col("split").eqNullSafe(F.col("c.split")),
    }
    hint = F.coalesce(F.col("c.task_type_hint"), F.lit(""))
    soft = {"candidate_category_mismatch": known & ~F.col("category").eqNullSafe(F.col("c.category")), "task_type_changed_by_teacher": F.col("target").isNotNull() & (hint != "") & ~F.col("target.task_type").eqNullSafe(hint)}
    x = x.select(*cols, case.alias("case_text"), F.array_sort(F.concat(_flags(own), e)).alias("errors"), r.alias("review"), F.array_sort(F.concat(_flags(soft), w)).alias("warnings"))
    return x.withColumn("status", F.when(F.size("errors") > 0, "rejected").when(F.size("review") > 0, "review").otherwise("accepted"))


def _coded(section: str, issues: Column, first: str = "section", second: str = "name") -> Column:
    """Array of struct (section, code) of the distinct codes of a list of issues."""
    return F.transform(F.array_distinct(F.transform(issues, T.issue_code)), lambda x: F.struct(F.lit(section).alias(first), x.alias(second)))


def issue_report(audit_rows: DataFrame) -> DataFrame:
    """``severity, code, rows``: how many rows have each issue code, in one pass over the audit."""
    x = audit_rows.select(F.explode(F.concat(*[_coded(c, F.col(c), "severity", "code") for c in ("errors", "review", "warnings")])).alias("i"))
    return x.groupBy("i.severity", "i.code").agg(F.count(F.lit(1)).alias("rows"))


def validation_report(audit_rows: DataFrame) -> DataFrame:
    """``section, name, rows, rate``: the histograms of a validation, in one pass: status, status by split, issue codes of each severity, task type,
    sufficiency, importance of evidence items, teacher model and prompt version. rate is the share of all rows for status, else null.
    """
    text = lambda c: F.coalesce(c, F.lit("None"))
    entry = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    one = lambda section, name: F.array(entry(section, name))
    items = F.transform(F.coalesce("target.evidence", F.array()), lambda e: entry("evidence_importance", text(e["importance"])))
    whole = F.array().cast("array<struct<section:string,name:string>>")
    known = F.col("split").isin("train", "validation", "test")
    parts = [
        one("all", F.lit("total")), one("status", F.col("status")), F.when(known, one("split_status", F.concat("split", F.lit(":"), "status"))).otherwise(whole),
        F.when(F.col("status") == "rejected", _coded("reject_reason", F.col("errors"))).otherwise(whole), F.when(F.col("status") == "review", _coded("review_reason", F.col("review"))).otherwise(whole), _coded("warning", F.col("warnings")),
        one("teacher_model", F.coalesce("teacher_model", F.lit("None"))), one("prompt_version", F.coalesce("prompt_version", F.lit("None"))),
        F.when(F.col("target").isNotNull(), F.concat(one("task_type", text(F.col("target.task_type"))), one("evidence_sufficiency", text(F.col("target.evidence_sufficiency"))), items)).otherwise(whole),
    ]
    x = audit_rows.select(F.explode(F.concat(*parts)).alias("i")).groupBy("i.section", "i.name").agg(F.count(F.lit(1)).alias("rows"))
    total = F.max(F.when(F.col("section") == "all", F.col("rows"))).over(Window.partitionBy(F.lit(1)))  # one row a name
    return x.select("section", "name", "rows", F.when(F.col("section") == "status", F.round(F.col("rows") / total, 6)).alias("rate"))
