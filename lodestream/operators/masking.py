"""Span-masked counterfactuals: eligible records, spans to mask, masked texts and paired effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.arrays import by_importance, overlapping
from lodestream.functions.hashing import digest
from lodestream.functions.text import delete_spans, occurrences, stripped

# What a clause is, and marks of a question.
CLAUSE = r"[^，,。；;！？!?：:\n]+"
QUERY_MARKS = "请问 想得到的帮助 想问 怎么办 怎么治疗 如何治疗 是否 是不是 ？ ?".split()


def located(case: Column, evidence: Column) -> Column:
    """Evidence items that occur exactly once in the case, with their own 0-based offsets."""
    once = F.filter(evidence, lambda e: F.coalesce(occurrences(case, e["span"]) == 1, F.lit(False)))
    return F.transform(once, lambda e: F.struct(e["id"].alias("id"), e["span"].alias("span"), e["importance"].alias("importance"), (F.position(e["span"], case) - 1).alias("span_start"), (F.position(e["span"], case) - 1 + F.length(e["span"])).alias("span_end")))


def valid_offsets(case: Column, evidence: Column) -> Column:
    """Every item stands where its offsets say, occurs once, and none overlap; null offsets are invalid."""
    here = F.forall(evidence, lambda e: F.coalesce((F.substr(case, e["span_start"] + 1, e["span_end"] - e["span_start"]) == e["span"]) & (occurrences(case, e["span"]) == 1), F.lit(False)))
    return F.coalesce(here & ~overlapping(evidence), F.lit(False))


def eligible(case: Column, evidence: Column, single: bool = True) -> Column:
    """At least one supporting and one (or exactly one) critical item, all with valid offsets."""
    n = F.size(by_importance(evidence, "critical"))
    return (n == 1 if single else n > 0) & (F.size(by_importance(evidence, "supporting")) > 0) & valid_offsets(case, evidence)


def nearest_supporting(record_id: Column, evidence: Column, seed: int = 42) -> Column:
    """The supporting item whose span is nearest in length to the first critical one; ties by hash."""
    aim = F.length(F.try_element_at(by_importance(evidence, "critical"), F.lit(1))["span"])
    ranked = F.transform(by_importance(evidence, "supporting"), lambda e: F.struct(F.abs(F.length(e["span"]) - aim).alias("far"), digest(seed, record_id, e["id"]).alias("tie"), e.alias("item")))
    return F.array_min(F.transform(ranked, lambda r: F.struct(r["far"], r["tie"], r["item"]["id"].alias("id"), r["item"]["span"].alias("span"), r["item"]["span_start"].alias("span_start"), r["item"]["span_end"].alias("span_end"))))


def random_clause(record_id: Column, case: Column, evidence: Column, aim: Column, seed: int = 42) -> Column:
    """A clause outside all evidence, unique, no question, of a length near ``aim``; null if there is none."""
    clauses = F.filter(F.transform(F.regexp_extract_all(case, F.lit(f"({CLAUSE})"), 1), stripped), lambda c: c != "")
    low, high = F.greatest(F.lit(2), F.floor(aim * 0.5)), F.greatest(aim * 2, aim + 8)
    at = F.transform(F.array_distinct(clauses), lambda c: F.struct(c.alias("span"), (F.position(c, case) - 1).alias("s"), (F.position(c, case) - 1 + F.length(c)).alias("e")))
    asks = "|".join(m if m != "?" else r"\?" for m in QUERY_MARKS)
    free = F.filter(at, lambda c: F.length(c["span"]).between(low, high) & (occurrences(case, c["span"]) == 1) & ~c["span"].rlike(asks) & ~F.exists(evidence, lambda e: F.coalesce((c["s"] < e["span_end"]) & (e["span_start"] < c["e"]), F.lit(False))))
    ranked = F.transform(free, lambda c: F.struct(F.abs(F.length(c["span"]) - aim).alias("far"), digest(seed, record_id, c["s"], c["span"]).alias("tie"), c["span"].alias("span"), c["s"].alias("span_start"), c["e"].alias("span_end")))
    return F.array_min(ranked)


def once(*columns: Column) -> Column:
    """Generator of one row with the values of the columns: what follows reads them, instead of computing them again at each use."""
    return F.inline(F.array(F.struct(*columns)))


def mask_variants(audited: DataFrame, candidate: DataFrame, seed: int = 42) -> DataFrame:
    """``source_id, split, variant_id, mask_type, removed, case_text``: up to three masked copies of each eligible record.

    Eligible are accepted records with one critical and at least one supporting item, none overlapping. critical removes the
    critical span, supporting the supporting span nearest to it in length, random a clause outside the
    evidence. Evidence is located by text, as stored offsets may be missing. Of several targets of a source_id the earliest counts, and the
    case that was loaded first. Records without a case or evidence give none.
    """
    case = candidate.where("case_text is not null and source_id is not null").groupBy("source_id").agg(F.min(F.struct("loaded_at", "case_text")).alias("c"))
    rows = audited.where("source_id is not null and target.evidence is not null and validation_status = 'accepted'").groupBy("source_id").agg(F.min(F.struct("created_at", "split", "target.evidence")).alias("t"))
    x = rows.join(case, "source_id").select("source_id", "t.split", "c.case_text", F.filter("t.evidence", lambda e: e["id"].isNotNull()).alias("stored"))
    x = x.select("source_id", "split", "case_text", once(located(F.col("case_text"), F.col("stored")).alias("evidence")))
    x = x.where(eligible(F.col("case_text"), F.col("evidence")))
    aim = F.length(F.element_at(by_importance(F.col("evidence"), "critical"), 1)["span"])
    found = [F.element_at(by_importance(F.col("evidence"), "critical"), 1).alias("crit"), nearest_supporting(F.col("source_id"), F.col("evidence"), seed).alias("sup"), random_clause(F.col("source_id"), F.col("case_text"), F.col("evidence"), aim, seed).alias("rnd")]
    x = x.select("source_id", "split", "case_text", once(*found))
    one = lambda kind, letter, c, i: F.struct(F.lit(kind).alias("mask_type"), F.concat(F.col("source_id"), F.lit(f"::{letter}:"), i).alias("variant_id"), F.col(c)["span"].alias("removed"), F.col(c)["span_start"].alias("span_start"), F.col(c)["span_end"].alias("span_end"))
    kinds = F.array(one("critical", "C", "crit", F.col("crit.id")), one("supporting", "S", "sup", F.col("sup.id")), one("random", "R", "rnd", F.lit("R1")))
    v = x.select("source_id", "split", "case_text", F.inline(kinds)).where("removed is not null")
    v = v.select("source_id", "split", "variant_id", "mask_type", "removed", once(delete_spans(F.col("case_text"), F.array(F.struct("span_start", "span_end"))).alias("case_text")))
    return v.where((F.col("case_text") != "") & ~F.contains("case_text", "removed"))


def paired_effect(rows: DataFrame, unit: str, arm: str, value: str, treatment: str, baseline: str) -> DataFrame:
    """One row: units in both arms, mean of each arm, difference, and units in which only one arm is true. ``value`` is boolean."""
    p = rows.where(F.col(unit).isNotNull()).groupBy(unit).agg(*[F.max(F.when(F.col(arm) == a, F.col(value).cast("int"))).alias(n) for a, n in ((treatment, "t"), (baseline, "b"))]).where("t is not null and b is not null")
    n = F.count(F.lit(1)).cast("bigint")
    return p.agg(n.alias("n"), F.round(F.avg("t"), 6).alias("treatment"), F.round(F.avg("b"), 6).alias("baseline"), F.round(100 * (F.avg("t") - F.avg("b")), 4).alias("delta_pp"), F.count_if((F.col("t") == 1) & (F.col("b") == 0)).alias("treatment_only"), F.count_if((F.col("t") == 0) & (F.col("b") == 1)).alias("baseline_only"))


def difference_in_differences(rows: DataFrame, unit: str, system: str, arm: str, value: str, systems: tuple[str, str], arms: tuple[str, str]) -> DataFrame:
    """One row: (new - old) in the first arm minus the same in the second, over units that have all four cells."""
    cells = [(s, a) for s in systems for a in arms]
    p = rows.groupBy(unit).agg(*[F.max(F.when((F.col(system) == s) & (F.col(arm) == a), F.col(value).cast("double"))).alias(f"c{i}") for i, (s, a) in enumerate(cells)])
    p = p.where("c0 is not null and c1 is not null and c2 is not null and c3 is not null").withColumn("did", (F.col("c0") - F.col("c2")) - (F.col("c1") - F.col("c3")))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("did"), 6).alias("did"), F.count_if(F.col("did") > 0).alias("positive"), F.count_if(F.col("did") < 0).alias("negative"))
