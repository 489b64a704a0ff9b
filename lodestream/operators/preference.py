"""Preference pairs: judgment checks, two-sided reconciliation, pair building and quota-bound selection."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.hashing import stable_id, stable_number

# Dimensions of a judgment with their highest scores, its decisions and failure codes.
SCORES = {"medical_correctness": 3, "evidence_faithfulness": 3, "answer_completeness": 3, "calibration": 3, "missing_information": 2, "actionability_safety": 2, "expression": 1}
DECISIONS = ("A_better", "B_better", "tie", "both_bad", "unjudgeable")
FAILURES = ("H1", "H2", "H3", "H4", "H5", "H6")
PAIR_GROUPS = {
    "target_vs_model": "target_vs_model",
    "model_vs_model": "model_vs_model",
    "controlled_negative": "controlled_negative",
    "target_vs_new": "target_vs_model",
    "best_existing_vs_new": "model_vs_model",
}
ANSWER_FIELDS = ("missing_information", "clinical_reasoning", "final_answer")


def pair_group(kind: Column) -> Column:
    """The group whose quota a pair type counts for; null for unknown types."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in PAIR_GROUPS.items() for x in kv]), kind)


def score_total(scores: Column) -> Column:
    """Sum over the dimensions; null scores give null."""
    return F.aggregate(F.map_values(scores), F.lit(0), lambda a, x: a + x)


def judgment_errors(j: Column) -> Column:
    """Sorted codes of what is wrong with a parsed judgment; a null judgment has judgment_missing only."""
    known = F.array(*[F.lit(k) for k in sorted(SCORES)])
    limits = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])
    codes = F.array(*[F.lit(x) for x in FAILURES])
    dims = j["decisive_dimensions"]
    rules: dict[str, Column] = {
        "invalid_decision": ~F.coalesce(j["decision"].isin(*DECISIONS), F.lit(False)),
        "invalid_confidence": ~F.coalesce(~F.isnan(j["confidence"]) & j["confidence"].between(0.0, 1.0), F.lit(False)),
        "missing_reason": F.coalesce(F.trim(j["reason"]), F.lit("")) == "",
        "invalid_decisive_dimensions": dims.isNull() | ((F.size(dims) == 0) & ~F.coalesce(j["decision"].isin("tie", "unjudgeable"), F.lit(False))) | (F.size(F.array_except(dims, known)) > 0),
    }
    for side in ("a", "b"):
        s, h = j["scores"][side], j["hard_failures"][side]
        rules[f"invalid_hard_failures:{side}"] = h.isNull() | (F.size(F.array_except(h, codes)) > 0)
        rules[f"invalid_scores:{side}"] = s.isNull() | ~F.array_sort(F.map_keys(s)).eqNullSafe(known) | F.exists(F.map_entries(s), lambda e: F.coalesce(~e["value"].between(0, F.element_at(limits, e["key"])), F.lit(True)))
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()])))
    return F.when(j.isNull(), F.array(F.lit("judgment_missing"))).otherwise(found)


def winner(decision: Column) -> Column:
    """a or b; null for other decisions."""
    return F.when(decision == "A_better", "a").when(decision == "B_better", "b")


def margin(j: Column) -> Column:
    """Score of the winner minus score of the other; null without a winner."""
    d = score_total(j["scores"]["a"]) - score_total(j["scores"]["b"])
    return F.when(j["decision"] == "A_better", d).when(j["decision"] == "B_better", -d)


def qualification(status: Column, j: Column, min_confidence: float = 0.85, min_margin: int = 2) -> Column:
    """The first gate a judged pair fails, or qualified."""
    failures = F.when(j["decision"] == "A_better", F.size(j["hard_failures"]["a"])).otherwise(F.size(j["hard_failures"]["b"]))
    return (
        F.when(~status.eqNullSafe(F.lit("ok")), "judgment_not_ok")
        .when(F.size(judgment_errors(j)) > 0, "invalid_judgment")
        .when(winner(j["decision"]).isNull(), F.concat(F.lit("decision:"), j["decision"]))
        .when(j["confidence"] < min_confidence, "low_confidence")
        .when(failures > 0, "chosen_judge_hard_failure")
        .when(margin(j) < min_margin, "low_score_margin")
        .otherwise("qualified")
    )


def swapped(j: Column) -> Column:
    """The judgment of the pair as if its sides had been shown the other way round."""
    decision = F.when(j["decision"] == "A_better", "B_better").when(j["decision"] == "B_better", "A_better").otherwise(j["decision"])
    flip = lambda c: F.struct(c["b"].alias("a"), c["a"].alias("b"))
    return j.withField("decision", decision).withField("hard_failures", flip(j["hard_failures"])).withField("scores", flip(j["scores"]))


def reconcile(first: Column, second: Column, min_confidence: float = 0.85, min_margin: int = 2, b_confidence: float = 0.9, b_direction: float = 1, b_average: float = 2.0) -> tuple[Column, Column]:
    """(tier, reason) of two judged rows of one pair, the second with swapped sides.

    A row is a struct of status, source_id, split, judge_model and j (its judgment); a null second row is missing. The first must pass
    all gates on its own, the second be valid and of the same pair and judge. Tier A: the second picks the same answer with confidence, margin and
    without a hard failure on it. Tier B: both confident, scores lean the same way, mean margin large enough and no hard
    failure. Else the first reason that fails, with original: or swap: before the reasons of one row.
    """
    j, other = first["j"], second["j"]
    gate = qualification(first["status"], j, min_confidence, min_margin)
    same_pair = first["source_id"].eqNullSafe(second["source_id"]) & first["split"].eqNullSafe(second["split"])
    s = swapped(other)
    side = winner(j["decision"])
    lean = lambda x: F.when(side == "a", score_total(x["scores"]["a"]) - score_total(x["scores"]["b"])).otherwise(score_total(x["scores"]["b"]) - score_total(x["scores"]["a"]))
    hard = lambda x: F.when(side == "a", F.size(x["hard_failures"]["a"])).otherwise(F.size(x["hard_failures"]["b"])) > 0
    strict = F.coalesce((winner(s["decision"]) == side) & (s["confidence"] >= min_confidence) & (lean(s) >= min_margin) & ~hard(s), F.lit(False))
    sure = (j["confidence"] >= b_confidence) & (s["confidence"] >= b_confidence)
    same = (lean(j) >= b_direction) & (lean(s) >= b_direction)
    far = (lean(j) + lean(s)) / 2.0 >= b_average
    reason = (
        F.when(gate != "qualified", F.concat(F.lit("original:"), gate)).when(second.isNull(), "swap:missing").when(~same_pair, "swap:metadata_mismatch")
        .when(~second["status"].eqNullSafe(F.lit("ok")), "swap:not_ok").when(F.size(judgment_errors(other)) > 0, "swap:invalid_judgment")
        .when(first["judge_model"].isNotNull() & ~first["judge_model"].eqNullSafe(second["judge_model"]), "swap:judge_model_mismatch")
        .when(strict, "strict_bidirectional_decision").when(~sure, "tier_b:low_confidence").when(~same, "tier_b:score_direction_inconsistent")
        .when(~far, "tier_b:low_average_margin").when(hard(j) | hard(s), "tier_b:winner_hard_failure").otherwise("score_consistent_bidirectional")
    )
    return F.when(reason == "strict_bidirectional_decision", "A").when(reason == "score_consistent_bidirectional", "B"), reason


def make_pair(source_id: Column, kind: Column, x: Column, y: Column, seed: int = 42) -> Column:
    """Struct pair_id, a, b: two candidates in a blind order by hash."""
    pair_id = stable_id("pair", source_id, kind, x, y, seed=seed)
    x_first = stable_number(pair_id, "blind_position", seed=seed) % 2 == 0
    return F.struct(pair_id.alias("pair_id"), F.when(x_first, x).otherwise(y).alias("a"), F.when(x_first, y).otherwise(x).alias("b"))


# Texts of the answer-level defects that are written on purpose: missing information, reasoning and answer.
NEGATIVES = {
    "overconfident_answer": ([], "现有资料已经足以形成明确判断，不需要再核对关键病史、体征或检查结果。", "根据当前描述已经可以得出确定结论，无需补充关键检查或病史，可直接按照该判断处理。"),
    "unnecessary_uncertainty": (["仍需补充所有相关病史和检查后才能进行任何判断"], "虽然现有证据已经较充分，但仍拒绝基于这些信息形成有针对性的判断或建议。", "目前完全无法提供任何有针对性的结论或下一步建议，只能等待更多信息后再作判断。"),
    "generic_non_answer": (None, "未结合病例中的关键证据进行分析，仅给出缺乏针对性的笼统建议。", "建议结合自身情况继续观察，并在需要时咨询专业人员以获得进一步帮助和处理建议。"),
}


def controlled_negative(source_id: Column, sufficiency: Column, seed: int = 42) -> Column:
    """Name of the deterministic answer-level defect for a target."""
    pick = stable_number(source_id, "controlled", seed=seed) % 2 == 0
    return F.when(pick, F.when(sufficiency == "sufficient", "unnecessary_uncertainty").otherwise("overconfident_answer")).otherwise("generic_non_answer")


def negative_answer(target: Column, defect: Column) -> Column:
    """Struct of the answer fields (missing_information, clinical_reasoning, final_answer) of a target with a defect written into them.

    A defect that says nothing of missing information leaves the target's own. Unknown defects give null.
    """
    fields = []
    for i, name in enumerate(ANSWER_FIELDS):
        value = None
        for k, texts in NEGATIVES.items():
            new = target[name] if texts[i] is None else F.array(*[F.lit(x) for x in texts[i]]).cast("array<string>") if i == 0 else F.lit(texts[i])
            value = F.when(defect == k, new) if value is None else value.when(defect == k, new)
        fields.append(value.alias(name))
    return F.when(defect.isin(*NEGATIVES), F.struct(*fields))


def select_pairs(pairs: DataFrame, target: int, weights: dict[str, float], per_source: int = 2, low: float = 0.45, high: float = 0.55, tier_b: float = 0.2) -> DataFrame:
    """``split, pair_id, pair_type, source_id, position, tier``: the largest feasible selection of each split, at most ``target``.

    Columns of ``pairs``: split, pair_id, pair_type, source_id, position (a or b), tier, confidence, margin. Types get
    largest-remainder quotas of the weights; those of natural types are split between the positions within ``low`` to ``high``, and at
    most a tenth are controlled; at most ``per_source`` pairs
    a source; of the natural pairs at most the share ``tier_b`` is of tier B. Pairs are taken by tier, confidence and margin,
    highest first, then by the greater pair_id, once with either natural type first. The choice depends on all earlier ones, so a split is one task; it gets
    only the best pairs that could enter: ``target`` of each type, position and tier after a source's best ``per_source``.
    Null tiers count as A. An empty selection gives no rows.
    """
    best = [F.asc("tier"), F.desc("confidence"), F.desc("margin"), F.desc("pair_id")]
    cells = Window.partitionBy("split", "pair_type", "position", "tier")
    x = pairs.where(F.col("pair_type").isin(*weights)).withColumn("tier", F.coalesce("tier", F.lit("A")))
    x = x.withColumn("_s", F.row_number().over(Window.partitionBy("split", "pair_type", "position", "tier", "source_id").orderBy(*best))).where(F.col("_s") <= per_source)
    x = x.withColumn("_c", F.row_number().over(cells.orderBy(*best))).where(F.col("_c") <= target * per_source).drop("_s", "_c")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("pair_id", ascending=False).sort_values(["confidence", "margin"], ascending=False, kind="stable").sort_values("tier", key=lambda t: t == "B", kind="stable").reset_index(drop=True)
        cells = _Cells(b, weights)
        for size in range(min(target, len(b)), 0, -1):
            quotas = type_quotas(size, weights)
            if quotas.get(CONTROLLED, 0) > int(size * MOST_CONTROLLED + 1e-9) or not cells.enough(quotas, low, high):
                continue
            for order in itertools.permutations(sorted(k for k in weights if k != CONTROLLED)):
                got = cells.attempt(quotas, (*order, CONTROLLED), per_source, low, high, tier_b)
                if got is not None:
                    return b.loc[got, cols]
        return b.iloc[:0][cols]

    cols = ["split", "pair_id", "pair_type", "source_id", "position", "tier"]
    return x.select(*cols, "confidence", "margin").groupBy("split").applyInPandas(run, "split string, pair_id string, pair_type string, source_id string, position string, tier string")


def type_quotas(size: int, weights: dict[str, float]) -> dict[str, int]:
    """Largest-remainder quotas; ties by (fraction, weight, name), descending."""
    base = {k: int(size * w + 1e-9) for k, w in weights.items()}
    left = size - sum(base.values())
    for k in sorted(weights, key=lambda k: (round(size * weights[k] - base[k], 9), weights[k], k), reverse=True)[:left]:
        base[k] += 1
    return base


CONTROLLED, MOST_CONTROLLED = "controlled_negative", 0.10


class _Cells:
    """The pairs of one split by type and position, best first, as (row, source, of tier B)."""

    def __init__(self, b: pd.DataFrame, weights: dict[str, float]) -> None:
        source = pd.factorize(b["source_id"])[0].tolist()
        self.cells: dict[tuple[str, str], list[tuple[int, int, bool]]] = {(k, p): [] for k in weights for p in ("a", "b", "")}
        for i, kind, pos, late in zip(range(len(b)), b["pair_type"], b["position"], (b["tier"] == "B").tolist(), strict=True):
            self.cells[kind, "" if kind == CONTROLLED else pos].append((i, source[i], late))

    def shares(self, kind: str, quota: int, low: float, high: float) -> list[int]:
        """Numbers of pairs in position a that the cells can give, nearest to half first."""
        lo, hi = math.ceil(quota * low), math.floor(quota * high)
        if lo > hi:
            return []
        aim = min(max(quota // 2, lo), hi)
        n_a, n_b = len(self.cells[kind, "a"]), len(self.cells[kind, "b"])
        return sorted((n for n in range(lo, hi + 1) if n <= n_a and quota - n <= n_b), key=lambda n: (abs(n - aim), n))

    def enough(self, quotas: dict[str, int], low: float, high: float) -> bool:
        """Whether each type has pairs enough, whatever their sources and tiers."""
        return all(len(self.cells[k, ""]) >= q if k == CONTROLLED else bool(self.shares(k, q, low, high)) for k, q in quotas.items())

    def attempt(self, quotas: dict[str, int], order: tuple[str, ...], per_source: int, low: float, high: float, tier_b: float) -> list[int] | None:
        """Rows of a selection that meets all quotas, or None; types choose in the given order, and do not choose again."""
        allowed = math.floor(sum(q for k, q in quotas.items() if k != CONTROLLED) * tier_b)
        used: dict[int, int] = {}
        taken: list[int] = []
        spent = 0

        def take(cell: list[tuple[int, int, bool]], need: int) -> tuple[list[int], dict[int, int], int] | None:
            rows, more, late = [], {}, 0
            for i, src, b_tier in cell:
                if len(rows) == need:
                    break
                if used.get(src, 0) + more.get(src, 0) >= per_source or (b_tier and spent + late >= allowed):
                    continue
                rows.append(i)
                more[src] = more.get(src, 0) + 1
                late += b_tier
            return (rows, more, late) if len(rows) == need else None

        def settle(got: tuple[list[int], dict[int, int], int], sign: int = 1) -> None:
            nonlocal spent
            for src, n in got[1].items():
                used[src] = used.get(src, 0) + sign * n
            spent += sign * got[2]

        for kind in order:
            if kind == CONTROLLED:
                got = take(self.cells[kind, ""], quotas.get(kind, 0)) if kind in quotas else ([], {}, 0)
                if got is None:
                    return None
                settle(got)
                taken += got[0]
                continue
            for n_a in self.shares(kind, quotas[kind], low, high):
                need = {"a": n_a, "b": quotas[kind] - n_a}
                scarce = sorted(need, key=lambda p: (len(self.cells[kind, p]) - need[p], p))
                first = take(self.cells[kind, scarce[0]], need[scarce[0]])
                if first is None:
                    continue
                settle(first)
                second = take(self.cells[kind, scarce[1]], need[scarce[1]])
                if second is not None:
                    settle(second)
                    taken += first[0] + second[0]
                    break
                settle(first, -1)
            else:
                return None
        return taken
