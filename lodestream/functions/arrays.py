"""Evidence arrays: normalisation, consistency, overlaps and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_strings(col: Column) -> Column:
    """Items without outer white space, blanks and nulls left out."""
    t = F.transform(col, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(t, lambda x: x.isNotNull() & (x != ""))


def valid_strings(col: Column, required: bool = False) -> Column:
    """Whether a list has only non-blank strings (and at least one)."""
    ok = col.isNotNull() & F.forall(col, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return ok & (F.size(col) > 0) if required else ok


def sorted_distinct(col: Column) -> Column:
    return F.array_sort(F.array_distinct(col))


def by_importance(evidence: Column, level: str) -> Column:
    return F.filter(evidence, lambda e: e["importance"] == level)


def spans_of(evidence: Column, critical_only: bool = False) -> Column:
    """Non-null spans in order."""
    ev = by_importance(evidence, "critical") if critical_only else evidence
    return F.filter(F.transform(ev, lambda e: e["span"]), lambda s: s.isNotNull())


def grounded(spans: Column, case: Column) -> Column:
    """Whether each span occurs in the case, in order."""
    return F.transform(spans, lambda s: F.contains(case, s))


def overlapping(evidence: Column) -> Column:
    """Whether two located spans overlap (0-based half-open offsets; unlocated ones are passed over)."""
    at = F.filter(evidence, lambda e: e["span_start"].isNotNull() & e["span_end"].isNotNull())
    s = F.array_sort(F.transform(at, lambda e: F.struct(e["span_start"].alias("a"), e["span_end"].alias("b"))))
    pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, y: F.coalesce(y["a"] < x["b"], F.lit(False)))
    return F.exists(pairs, lambda x: x)


def critical_consistent(evidence: Column, critical: Column) -> Column:
    """Ids and critical ids are unique, and the critical ids are those of the items marked critical."""
    ids = F.transform(evidence, lambda e: e["id"])
    marked = F.transform(by_importance(evidence, "critical"), lambda e: e["id"])
    unique = (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_distinct(critical)) == F.size(critical))
    return unique & (F.size(F.array_except(critical, marked)) == 0) & (F.size(F.array_except(marked, critical)) == 0)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Number of common items, counted as often as both lists have them."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two sets of spans; recall is 1 and precision 0 where both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    p = F.when(F.size(x) > 0, both / F.size(x)).otherwise(0.0)
    r = F.when(F.size(y) > 0, both / F.size(y)).otherwise(1.0)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def alignment_signature(evidence: Column) -> Column:
    """Sorted (span, importance) pairs and sorted critical spans."""
    return F.struct(F.array_sort(F.transform(evidence, lambda e: F.struct(e["span"], e["importance"]))).alias("items"), F.array_sort(spans_of(evidence, True)).alias("critical"))


def changed_fields(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    """Names of the fields in which two structs differ."""
    return F.array_compact(F.array(*[F.when(~a[f].eqNullSafe(b[f]), F.lit(f)) for f in fields]))


def without_offsets(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.struct(*[e[f].alias(f) for f in ("id", "span", "importance", "role")]))
