"""Preference pairs from audited sources: which sources take part, model answers projected onto their target, pairs, exported rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.arrays import changed_fields, without_offsets
from lodestream.functions.hashing import stable_number
from lodestream.functions.jsonx import compact
from lodestream.operators.audit import target_issues
from lodestream.operators.masking import once
from lodestream.operators.preference import ANSWER_FIELDS, controlled_negative, make_pair, negative_answer
from lodestream.operators.records import overlay_answer

# Shares of the sufficiency levels among selected sources, in order of choice, and the versions of exported rows.
LEVEL_SHARES = {"partial": 0.55, "insufficient": 0.25, "sufficient": 0.19, "conflicting": 0.01}
SCHEMA_VERSION, SCOPE = "evidence-dpo-answer-v1", "answer_level"


def text_of(target: Column) -> Column:
    """A target as JSON without the offsets of its evidence."""
    return compact(target.withField("evidence", without_offsets(target["evidence"])))


def select_sources(eligible: DataFrame, limits: dict[str, int], medium_share: float = 0.15, seed: int = 42) -> DataFrame:
    """``source_id, split, level, task_type, risk`` of the chosen sources.

    Columns of ``eligible``: those, with risk the warning risk. Only splits in ``limits`` take part. Of the medium risks at most
    the share ``medium_share`` of a split's target stays, by hash. Levels get their shares of the target, by turns between
    task types in hash order; places left are filled in hash order. source_ids must be distinct; null ids never take part.
    """
    h = lambda *parts: stable_number(*parts, seed=seed)
    i = F.col("source_id")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("split"))
    split = Window.partitionBy("split")
    x = eligible.where(F.col("split").isin(*limits) & i.isNotNull()).withColumn("target", F.least(limit, F.count(F.lit(1)).over(split)))
    medium = F.row_number().over(Window.partitionBy("split", "risk").orderBy(h(i, "medium-risk"), i))
    x = x.withColumn("_m", medium).where((F.col("risk") != "medium") | (F.col("_m") <= F.floor(F.col("target") * medium_share)))
    x = x.withColumn("target", F.least("target", F.count(F.lit(1)).over(split)))
    cell = Window.partitionBy("split", "level")
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in LEVEL_SHARES.items() for v in kv]), F.col("level")), F.lit(0.0))
    quota = F.least(F.count(F.lit(1)).over(cell), F.bround(F.col("target") * share, 0))
    turn = F.row_number().over(Window.partitionBy("split", "level", "task_type").orderBy(h(i), i))
    spelled = F.array_join(F.split(F.coalesce("task_type", F.lit("None")), "(?!^)(?!$)"), ":")
    x = x.withColumns({"quota": quota, "turn": turn, "kind": h(spelled)})
    x = x.withColumn("chosen", F.row_number().over(cell.orderBy("turn", "kind", "task_type")) <= F.col("quota"))
    left = F.col("target") - F.sum(F.col("chosen").cast("int")).over(split)
    fill = F.row_number().over(Window.partitionBy("split", "chosen").orderBy(h(i, "fill"), i))
    x = x.withColumns({"left": left, "fill": fill}).where(F.col("chosen") | (F.col("fill") <= F.col("left")))
    return x.select("source_id", "split", "level", "task_type", "risk")


def projected(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """``source_id, candidate_id, response, warnings``: model answers laid over their source's target and audited; each answer once.

    Columns of ``sources``: source_id, case_text, target; of ``candidates``: source_id, candidate_id, no (its place in the record), answer (a
    struct of the answer fields). Answers with a null field or an invalid list, answers equal to the target's, and responses with an audit error are
    left out; of equal answers of a source the one in the first place counts. ``warnings`` is the number of warnings and review points.
    """
    x = candidates.join(sources.select("source_id", "case_text", "target"), "source_id")
    sound = F.forall(F.col("answer.missing_information"), lambda m: m.isNotNull() & (F.trim(m) != ""))
    blank = F.lit(False)
    for f in ("clinical_reasoning", "final_answer"):
        blank = blank | (F.trim(F.col(f"answer.{f}")) == "")
    changed = F.size(changed_fields(F.col("target"), F.col("answer"), ANSWER_FIELDS)) > 0
    x = x.where(F.coalesce(sound & ~blank & changed, F.lit(False))).withColumn("response", overlay_answer(F.col("target"), F.col("answer"))).where("response is not null")
    errors, review, warnings = target_issues(F.col("case_text"), F.col("response"))
    x = x.select("*", once(F.size(errors).alias("errors"), (F.size(review) + F.size(warnings)).alias("warnings"))).where("errors = 0")
    first = Window.partitionBy("source_id", *[F.col(f"answer.{f}") for f in ANSWER_FIELDS]).orderBy("no", "candidate_id")
    same = F.col("answer.missing_information").eqNullSafe(F.col("target.missing_information"))
    return x.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("source_id", "candidate_id", "response", "warnings", same.alias("same_missing"))


def build_pairs(sources: DataFrame, candidates: DataFrame, seed: int = 42) -> DataFrame:
    """``pair_id, pair_type, source_id, split, difference_fields, candidate_a, candidate_b, response_a, response_b`` in blind order.

    Per source: the target against the model answer of lowest rank, the best against the worst model answer where there are two, and
    the target against a negative with a defect written into it, if that passes the audit. Columns of ``sources``: source_id, split, case_text, target.
    """
    models = projected(sources, candidates)
    tie = stable_number("answer_rank_tie", F.col("source_id"), F.col("candidate_id"), seed=seed)
    rank = F.struct((F.col("warnings") == 0).alias("clean"), F.col("same_missing"), (-F.col("warnings")).alias("few"), tie.alias("tie"))
    option = F.struct("candidate_id", "response")
    ends = models.groupBy("source_id").agg(F.min_by(option, rank).alias("worst"), F.max_by(option, rank).alias("best"), F.count(F.lit(1)).alias("n"))
    target = F.struct(F.lit("validated_target").alias("candidate_id"), F.col("target").alias("response"))
    x = sources.select("source_id", "split", "case_text", target.alias("t"), controlled_negative(F.col("source_id"), F.col("target.evidence_sufficiency"), seed).alias("defect"))
    negative = overlay_answer(F.col("t.response"), negative_answer(F.col("t.response"), F.col("defect")))
    x = x.withColumn("c", F.when(negative.isNotNull(), F.struct(F.concat(F.lit("controlled_"), F.col("defect")).alias("candidate_id"), negative.alias("response"))))
    passes = (F.size(target_issues(F.col("case_text"), F.col("c.response"))[0]) == 0) & (F.size(changed_fields(F.col("t.response"), F.col("c.response"), ANSWER_FIELDS)) > 0)
    x = x.select("*", once(F.coalesce(passes, F.lit(False)).alias("passes"))).join(ends, "source_id", "left")
    kind = lambda name, on, a, b: F.when(on, F.struct(F.lit(name).alias("pair_type"), F.col(a).alias("x"), F.col(b).alias("y")))
    made = F.array_compact(F.array(kind("target_vs_model", F.col("n") >= 1, "t", "worst"), kind("model_vs_model", F.col("n") >= 2, "best", "worst"), kind("controlled_negative", F.col("passes"), "t", "c")))
    p = x.select("source_id", "split", F.inline(made))
    pair = make_pair(F.col("source_id"), F.col("pair_type"), F.col("x.candidate_id"), F.col("y.candidate_id"), seed)
    p = p.withColumn("p", pair).withColumn("x_first", F.col("p.a") == F.col("x.candidate_id"))
    side = lambda first, f: F.when(F.col("x_first") == first, F.col("x")[f]).otherwise(F.col("y")[f])
    return p.select(
        "p.pair_id", "pair_type", "source_id", "split", changed_fields(F.col("x.response"), F.col("y.response"), ANSWER_FIELDS).alias("difference_fields"),
        side(True, "candidate_id").alias("candidate_a"), side(False, "candidate_id").alias("candidate_b"), side(True, "response").alias("response_a"), side(False, "response").alias("response_b"),
    )


def export_rows(pairs: DataFrame, winners: DataFrame, prompts: DataFrame) -> DataFrame:
    """``schema_version, preference_scope, source_id, pair_id, prompt, chosen, rejected, pair_type, difference_fields, position`` of judged pairs.

    ``winners`` has pair_id and winner (a or b; others are left out), ``prompts`` source_id and prompt. Responses are written as JSON without offsets.
    Pairs whose texts are equal are left out.
    """
    x = pairs.join(winners.where(F.col("winner").isin("a", "b")).select("pair_id", "winner"), "pair_id").join(prompts.select("source_id", "prompt"), "source_id")
    a_wins = F.col("winner") == "a"
    x = x.withColumns({"ta": text_of(F.col("response_a")), "tb": text_of(F.col("response_b"))}).where("ta <> tb")
    return x.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(SCOPE).alias("preference_scope"), "source_id", "pair_id", "prompt", F.when(a_wins, F.col("ta")).otherwise(F.col("tb")).alias("chosen"),
        F.when(a_wins, F.col("tb")).otherwise(F.col("ta")).alias("rejected"), "pair_type", "difference_fields", F.col("winner").alias("position"),
    )
