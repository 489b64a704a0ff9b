"""Queries over predictions, masked variants and judgments, each with SQL. Predictions and judgments are stand-ins made by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import hashing as H
from lodestream.operators import evaluation as EV
from lodestream.operators import exam, masking, sampling
from lodestream.operators import prompts as PM
from lodestream.plans import core
from lodestream.plans.core import Query, big, rows_as
from lodestream.session import materialize, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def put(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _n(*parts: str) -> str:
    return core._HEAD.format("'42:' || " + " || ':' || ".join(parts))


# Predictions: the gold target with spans dropped or altered, types and levels changed, blanks and unparsable texts.
_GOLD = f"SELECT a.source_id, a.split, a.target AS gold, c.case_text FROM (SELECT * FROM audited WHERE source_id IS NOT NULL AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at NULLS FIRST, split NULLS FIRST) = 1) a JOIN ({core._CASES}) c ON a.source_id = c.source_id"
_PREDICTED = f"""CASE WHEN {_n('key', "'none'")} % 13 = 0 THEN NULL ELSE {{'task_type': CASE WHEN {_n('key', "'task'")} % 7 = 0 THEN 'confirmed_management' ELSE gold.task_type END, 'query_intent': CASE WHEN {_n('key', "'intent'")} % 11 = 0 THEN [] ELSE gold.query_intent END,
 'evidence_sufficiency': CASE {_n('key', "'level'")} % 6 WHEN 0 THEN 'insufficient' WHEN 1 THEN 'unknown' ELSE gold.evidence_sufficiency END,
 'evidence': list_transform(list_filter(gold.evidence, lambda e: coalesce(substr(sha256('42:' || e.span), 1, 1) < 'c', true)), lambda e: {{'id': e.id, 'span': CASE WHEN substr(sha256('42:' || e.span), 1, 1) < '2' THEN e.span || '。' ELSE e.span END, 'importance': e.importance, 'role': e.role, 'span_start': e.span_start, 'span_end': e.span_end}}),
 'critical_evidence_ids': gold.critical_evidence_ids, 'missing_information': gold.missing_information, 'clinical_reasoning': gold.clinical_reasoning, 'final_answer': CASE WHEN {_n('key', "'answer'")} % 9 = 0 THEN ' ' ELSE gold.final_answer END}} END"""


def _gold(s: SparkSession, d: str) -> DataFrame:
    row = F.min(F.struct("created_at", "split", "target")).alias("t")
    c = table(s, d, "candidate").where("case_text is not null and source_id is not null").groupBy("source_id").agg(F.max("case_text").alias("case_text"))
    return table(s, d, "audited").where("source_id is not null and target is not null").groupBy("source_id").agg(row).join(c, "source_id").select("source_id", "t.split", F.col("t.target").alias("gold"), "case_text")


def _predicted(key: Column, gold: Column) -> Column:
    n = lambda x, m: H.stable_number(key, x) % m
    head = lambda e: F.substring(H.order_key(e["span"]), 1, 1)
    kept = F.filter(gold["evidence"], lambda e: F.coalesce(head(e) < "c", F.lit(True)))
    out = gold.withField("task_type", F.when(n("task", 7) == 0, "confirmed_management").otherwise(gold["task_type"]))
    out = out.withField("query_intent", F.when(n("intent", 11) == 0, F.array().cast("array<string>")).otherwise(gold["query_intent"]))
    out = out.withField("evidence_sufficiency", F.when(n("level", 6) == 0, "insufficient").when(n("level", 6) == 1, "unknown").otherwise(gold["evidence_sufficiency"]))
    out = out.withField("evidence", F.transform(kept, lambda e: e.withField("span", F.when(head(e) < "2", F.concat(e["span"], F.lit("。"))).otherwise(e["span"]))))
    out = out.withField("final_answer", F.when(n("answer", 9) == 0, " ").otherwise(gold["final_answer"]))
    return F.when(n("none", 13) != 0, out)


def _bad(field: str, ok: str) -> str:
    return f"len(list_filter(list_filter(coalesce(pred.evidence, []), lambda e: e IS NOT NULL), lambda e: NOT ({ok.replace('@', 'e.' + field)}))) > 0"


_STRIPPED = lambda c: f"coalesce({core._STRIP.format(c)}, '')"
_VALID = lambda f, need: f"(pred.{f} IS NOT NULL AND len(list_filter(pred.{f}, lambda i: i IS NULL OR trim(i) = '')) = 0" + (f" AND len(pred.{f}) > 0)" if need else ")")
_SCHEMA = (
    "CASE WHEN pred IS NULL THEN ['not_object'] ELSE "
    + core._coded(
        {
            "invalid_task_type": "coalesce(pred.task_type, '') NOT IN ('diagnostic_reasoning', 'confirmed_management')", "invalid_sufficiency": "coalesce(pred.evidence_sufficiency, '') NOT IN ('sufficient', 'partial', 'insufficient', 'conflicting')",
            "invalid_query_intent": f"NOT {_VALID('query_intent', True)}", "invalid_critical_ids": f"NOT {_VALID('critical_evidence_ids', False)}", "invalid_missing_information": f"NOT {_VALID('missing_information', False)}",
            "invalid_clinical_reasoning": _STRIPPED("pred.clinical_reasoning") + " = ''", "invalid_final_answer": _STRIPPED("pred.final_answer") + " = ''", "invalid_evidence": "pred.evidence IS NULL",
            "evidence_not_object": "len(list_filter(coalesce(pred.evidence, []), lambda e: e IS NULL)) > 0", **{f"invalid_evidence_{f}": _bad(f, f"{_STRIPPED('@')} <> ''") for f in ("id", "span", "role")},
            "invalid_evidence_importance": _bad("importance", "coalesce(@, '') IN ('critical', 'supporting')"),
        }
    )
    + " END"
)


def _spans(t: str, critical: bool = False) -> str:
    on = f" AND list_contains(coalesce({t}.critical_evidence_ids, []), e.id)" if critical else ""
    return f"list_transform(list_filter(coalesce({t}.evidence, []), lambda e: coalesce(e.span IS NOT NULL{on}, false)), lambda e: e.span)"


def _overlap(a: str, b: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0) AS BIGINT)"


_METRICS = f"""p1 AS (SELECT *, {_spans('pred')} AS ps, {_spans('gold')} AS gs, {_spans('pred', True)} AS pc, {_spans('gold', True)} AS gc, {_SCHEMA} AS schema_errors, list_transform(list_filter(coalesce(pred.evidence, []), lambda e: e.importance = 'critical'), lambda e: e.id) AS marked,
 list_transform(coalesce(pred.evidence, []), lambda e: e.id) AS ids, coalesce(pred.critical_evidence_ids, []) AS crit FROM p0),
p2 AS (SELECT *, pred IS NOT NULL AND {_n('key', "'strict'")} % 3 <> 0 AS strict_json_valid, pred IS NOT NULL AS recoverable_json_valid, len(schema_errors) = 0 AS schema_valid, len(list_filter(ps, lambda x: contains(case_text, x))) AS grounded_evidence, len(ps) AS predicted_evidence, len(gs) AS gold_evidence, {_overlap('ps', 'gs')} AS evidence_overlap,
 len(pc) AS predicted_critical, len(gc) AS gold_critical, {_overlap('pc', 'gc')} AS critical_overlap,
 coalesce(pred.evidence IS NOT NULL AND len(list_filter(ids, lambda i: i IS NULL)) = 0 AND len(list_distinct(ids)) = len(ids) AND len(list_distinct(crit)) = len(crit) AND len(list_filter(crit, lambda i: NOT list_contains(marked, i))) = 0 AND len(list_filter(marked, lambda i: NOT list_contains(crit, i))) = 0, false) AS critical_consistent,
 pred IS NOT NULL AND pred.task_type IS NOT DISTINCT FROM gold.task_type AS task_type_correct, pred IS NOT NULL AND pred.evidence_sufficiency IS NOT DISTINCT FROM gold.evidence_sufficiency AS sufficiency_correct, pred IS NOT NULL AND {_STRIPPED('pred.final_answer')} <> '' AS final_answer_nonempty FROM p1),
scored AS (SELECT *, predicted_evidence > 0 AND grounded_evidence = predicted_evidence AS all_evidence_grounded FROM p2)"""
_SCORED = f"WITH p0 AS (SELECT *, {_PREDICTED} AS pred FROM (SELECT *, source_id AS key FROM ({_GOLD}))), {_METRICS}"
_RATE = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE round_even({a} / {b}, 6) END"


def _aggregate(by: str) -> str:
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    sums = ", ".join([f"count(*) FILTER ({f}) AS {f}_count" for f in EV.FLAGS] + [f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in EV.COUNTS])
    rates = ", ".join([f"{_RATE(f + '_count', 'samples')} AS {f}_rate" for f in EV.FLAGS] + [f"{_RATE(a, b)} AS {n}" for a, b, n in (("grounded_evidence", "predicted_evidence", "grounding_rate"), ("evidence_overlap", "predicted_evidence", "evidence_precision"), ("evidence_overlap", "gold_evidence", "evidence_recall"), ("critical_overlap", "predicted_critical", "critical_precision"), ("critical_overlap", "gold_critical", "critical_recall"))])
    f1 = ", ".join(f"{_RATE(f'2 * {k}_precision * {k}_recall', f'({k}_precision + {k}_recall)')} AS {k}_f1" for k in ("evidence", "critical"))
    return f" SELECT *, {f1} FROM (SELECT *, {rates} FROM (SELECT {lead}count(*) AS samples, {sums} FROM scored{group}))"


def _scored(s: SparkSession, d: str) -> DataFrame:
    x = _gold(s, d).withColumn("pred", _predicted(F.col("source_id"), F.col("gold")))
    return x.select("source_id", "split", "gold", "pred", EV.prediction_metrics(F.col("pred"), H.stable_number(F.col("source_id"), "strict") % 3 != 0, F.col("gold"), F.col("case_text")).alias("m"))


@query(_SCORED + f" SELECT source_id, {', '.join(EV.FLAGS)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in EV.COUNTS)}, array_to_string(schema_errors, '|') AS schema_errors FROM scored")
def scored_predictions(s: SparkSession, d: str) -> DataFrame:
    x = _scored(s, d)
    return x.select("source_id", *[f"m.{f}" for f in EV.FLAGS], *[big(F.col(f"m.{c}")).alias(c) for c in EV.COUNTS], F.array_join(EV.schema_errors(F.col("pred")), "|").alias("schema_errors"))


@query(_SCORED + _aggregate(""))
def prediction_report(s: SparkSession, d: str) -> DataFrame:
    return EV.aggregate_metrics(_scored(s, d), "m")


@query(_SCORED + " SELECT code, count(*) AS n FROM (SELECT unnest(schema_errors) AS code FROM scored) GROUP BY code")
def schema_error_counts(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select(F.explode(EV.schema_errors(F.col("pred"))).alias("code")).groupBy("code").agg(rows_as("n"))


_CLASSES = """cell AS (SELECT {by} AS k, coalesce(gold.evidence_sufficiency, 'None') AS g, coalesce(pred.evidence_sufficiency, 'None') AS p, count(*) AS n FROM scored GROUP BY ALL), sup AS (SELECT k, g AS label, sum(n) AS support, coalesce(sum(n) FILTER (g = p), 0) AS hit FROM cell GROUP BY k, g), giv AS (SELECT k, p AS label, sum(n) AS given FROM cell GROUP BY k, p),
cls AS (SELECT sup.*, coalesce(given, 0) AS given, CASE WHEN sup.label IN ('sufficient', 'partial', 'insufficient', 'conflicting') THEN round_even(2 * hit / (coalesce(given, 0) + support), 6) END AS f1, CASE WHEN sup.label IN ('sufficient', 'partial', 'insufficient', 'conflicting') THEN round_even(hit / support, 6) END AS rc FROM sup LEFT JOIN giv ON sup.k IS NOT DISTINCT FROM giv.k AND sup.label = giv.label)
SELECT k AS {name}, CAST(sum(support) AS BIGINT) AS samples, round_even(sum(hit) / sum(support), 6) AS accuracy, round_even(max(support) / sum(support), 6) AS majority_rate, coalesce(round_even(avg(f1), 6), 0.0) AS macro_f1, coalesce(round_even(avg(rc), 6), 0.0) AS balanced_accuracy FROM cls GROUP BY k"""


@query(_SCORED + ", " + _CLASSES.format(by="coalesce(split, 'none')", name="split"))
def sufficiency_report(s: SparkSession, d: str) -> DataFrame:
    x = _scored(s, d).select(F.coalesce("split", F.lit("none")).alias("split"), F.col("gold.evidence_sufficiency").alias("g0"), F.col("pred.evidence_sufficiency").alias("p0"))
    return EV.class_summary(x, "split", "g0", "p0").withColumn("samples", big(F.col("samples")))


# Masked variants with predictions and judgments

_MASKED = f"""WITH variants AS ({core._VARIANTS} SELECT * FROM variants), g AS ({_GOLD}), u AS (SELECT source_id AS parent, 'unmasked' AS mask_type, source_id || '::U' AS key, split, gold, case_text, NULL AS removed FROM g WHERE source_id IN (SELECT source_id FROM variants)
UNION ALL SELECT v.source_id, v.mask_type, v.variant_id, g.split, g.gold, v.case_text, v.removed FROM variants v JOIN g ON v.source_id = g.source_id), p0 AS (SELECT *, {_PREDICTED} AS pred FROM u), {_METRICS},
judged AS (SELECT *, CASE {_n('key', "'expected'")} % 3 WHEN 0 THEN 'stay' WHEN 1 THEN 'downgrade' END AS expected, coalesce(removed <> '' AND list_contains(ps, removed), false) AS evidence_leakage, coalesce(removed <> '' AND contains(coalesce(pred.clinical_reasoning, '') || coalesce(pred.final_answer, ''), removed), false) AS literal_mention,
 {", ".join(f"{_n('key', chr(39) + f + chr(39))} % 4 > 0 AS {f}" for f in EV.RESPONSE_FLAGS)}, ['downgrade', 'stay', 'unjustified_change', 'overconfident'][CAST({_n('key', "'behaviour'")} % 4 AS INT) + 1] AS behaviour FROM scored)"""


def _masked(s: SparkSession, d: str) -> DataFrame:
    """Variants and their unmasked parents with predictions, metrics and judgments."""
    v = materialize(masking.mask_variants(table(s, d, "audited"), table(s, d, "candidate")), "variants")
    g = _gold(s, d)
    cols = ["parent", "mask_type", "key", "split", "gold", "case_text", "removed"]
    u = g.join(v.select("source_id").distinct(), "source_id").select(F.col("source_id").alias("parent"), F.lit("unmasked").alias("mask_type"), F.concat("source_id", F.lit("::U")).alias("key"), "split", "gold", "case_text", F.lit(None).cast("string").alias("removed"))
    m = v.select(F.col("source_id").alias("parent"), "mask_type", F.col("variant_id").alias("key"), "case_text", "removed").join(g.select(F.col("source_id").alias("parent"), "split", "gold"), "parent").select(*cols)
    x = u.unionByName(m).withColumn("pred", _predicted(F.col("key"), F.col("gold")))
    k = F.col("key")
    text = F.concat(F.coalesce("pred.clinical_reasoning", F.lit("")), F.coalesce("pred.final_answer", F.lit("")))
    e = H.stable_number(k, "expected") % 3
    x = x.withColumns({"m": EV.prediction_metrics(F.col("pred"), H.stable_number(k, "strict") % 3 != 0, F.col("gold"), F.col("case_text")), "r": EV.removed_span_metrics(F.col("pred"), text, F.array("removed")), "expected": F.when(e == 0, "stay").when(e == 1, "downgrade")})
    behaviour = F.element_at(F.array(*[F.lit(b) for b in EV.BEHAVIOURS]), (H.stable_number(k, "behaviour") % 4 + 1).cast("int"))
    return x.withColumns({f: H.stable_number(k, f) % 4 > 0 for f in EV.RESPONSE_FLAGS}).withColumn("behaviour", behaviour)


@query(_MASKED + _aggregate("mask_type"))
def masked_report(s: SparkSession, d: str) -> DataFrame:
    return EV.aggregate_metrics(_masked(s, d), "m", "mask_type")


@query(_MASKED + " SELECT mask_type, count(*) FILTER (evidence_leakage) AS evidence_leakage, count(*) FILTER (literal_mention) AS literal_mention, count(*) AS samples FROM judged GROUP BY mask_type")
def removed_fact_report(s: SparkSession, d: str) -> DataFrame:
    return _masked(s, d).groupBy("mask_type").agg(F.count_if("r.evidence_leakage").alias("evidence_leakage"), F.count_if("r.literal_mention").alias("literal_mention"), rows_as("samples"))


@query(_MASKED + ", " + _CLASSES.format(by="mask_type", name="mask_type"))
def masked_sufficiency(s: SparkSession, d: str) -> DataFrame:
    x = _masked(s, d).select("mask_type", F.col("gold.evidence_sufficiency").alias("g0"), F.col("pred.evidence_sufficiency").alias("p0"))
    return EV.class_summary(x, "mask_type", "g0", "p0").withColumn("samples", big(F.col("samples")))


_RANK = "CASE {0} WHEN 'insufficient' THEN 0 WHEN 'partial' THEN 1 WHEN 'sufficient' THEN 2 END"


@query(_MASKED + f""", c AS (SELECT m.mask_type, CASE m.expected WHEN 'downgrade' THEN {_RANK.format('m.pred.evidence_sufficiency')} < {_RANK.format('u.pred.evidence_sufficiency')} WHEN 'stay' THEN {_RANK.format('m.pred.evidence_sufficiency')} = {_RANK.format('u.pred.evidence_sufficiency')} END AS ok
FROM judged m JOIN judged u ON m.parent = u.parent AND u.mask_type = 'unmasked' WHERE m.mask_type <> 'unmasked') SELECT mask_type, count(*) AS eligible, count(*) FILTER (ok) AS appropriate, round_even(count(*) FILTER (ok) / count(*), 6) AS rate FROM c WHERE ok IS NOT NULL GROUP BY mask_type""")
def expected_changes(s: SparkSession, d: str) -> DataFrame:
    """Masked against unmasked prediction of a parent: whether sufficiency changed as expected."""
    x = materialize(_masked(s, d).select("parent", "mask_type", "expected", F.col("pred.evidence_sufficiency").alias("level")), "masked-levels")
    u = x.where("mask_type = 'unmasked'").select("parent", F.col("level").alias("unmasked"))
    ok = x.where("mask_type <> 'unmasked'").join(u, "parent").select("mask_type", EV.expected_change(F.col("expected"), F.col("unmasked"), F.col("level")).alias("ok")).where("ok is not null")
    n = F.count(F.lit(1))
    return ok.groupBy("mask_type").agg(n.alias("eligible"), F.count_if("ok").alias("appropriate"), F.bround(F.count_if("ok") / n, 6).alias("rate"))


@query(_MASKED + f" SELECT mask_type, count(*) AS judged, {', '.join(f'count(*) FILTER ({f}) AS {f}_count, round_even(count(*) FILTER ({f}) / count(*), 6) AS {f}_rate' for f in EV.RESPONSE_FLAGS)} FROM judged WHERE mask_type <> 'unmasked' GROUP BY mask_type")
def response_judgments(s: SparkSession, d: str) -> DataFrame:
    return EV.judge_summary(_masked(s, d).where("mask_type <> 'unmasked'"), "mask_type", *EV.RESPONSE_FLAGS)


@query(_MASKED + " SELECT mask_type, behaviour, count(*) AS n FROM judged WHERE mask_type <> 'unmasked' GROUP BY ALL")
def response_behaviours(s: SparkSession, d: str) -> DataFrame:
    return _masked(s, d).where("mask_type <> 'unmasked'").groupBy("mask_type", "behaviour").agg(rows_as("n"))


@query(f"""WITH variants AS ({core._VARIANTS} SELECT * FROM variants), v AS (SELECT source_id AS parent, mask_type, max(variant_id) AS variant_id FROM variants GROUP BY ALL), f AS (SELECT parent FROM (SELECT parent, sha256('42:' || parent) AS h FROM v WHERE mask_type IN ('critical', 'supporting') GROUP BY parent HAVING count(*) = 2) ORDER BY h, parent LIMIT 20)
SELECT parent AS pair_id, 'unmasked' AS mask_type, parent || '::U' AS variant_id FROM f UNION ALL SELECT v.parent, v.mask_type, v.variant_id FROM v JOIN f ON v.parent = f.parent""")
def paired_variants(s: SparkSession, d: str) -> DataFrame:
    v = materialize(masking.mask_variants(table(s, d, "audited"), table(s, d, "candidate")), "variants")
    return EV.paired_variants(v.select(F.col("source_id").alias("parent"), "mask_type", "variant_id"), 20)


# Judgments of other kinds, exam checks and report projections


@query(f"""WITH j AS (SELECT pair_id, parsed_judgment AS j FROM judgment WHERE parsed_judgment IS NOT NULL AND pair_id IS NOT NULL), x AS (SELECT DISTINCT pair_id, j.decision AS decision, j.reason AS reason, {_n('pair_id', "'score'")} % 7 AS a, {_n('pair_id', "'score'")} % 5 AS b, {_n('pair_id', "'flag'")} % 9 > 0 AS flag FROM j)
SELECT decision, count(*) AS n, count(*) FILTER (decision IN ('A_better', 'B_better', 'tie', 'both_bad', 'unjudgeable') AND a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5 AND flag AND coalesce(trim(reason), '') <> '') AS valid FROM x GROUP BY decision""")
def clinical_judgments(s: SparkSession, d: str) -> DataFrame:
    """Valid clinical judgments by decision; scores and error flags are stand-ins, one in nine flags is missing."""
    j = table(s, d, "judgment").where("parsed_judgment is not null and pair_id is not null").select("pair_id", "parsed_judgment.decision", "parsed_judgment.reason").distinct()
    n = lambda x, m: (H.stable_number(F.col("pair_id"), x) % m).cast("int")
    scores = F.struct(*[F.map_from_arrays(F.array(*[F.lit(k) for k in EV.CLINICAL_DIMENSIONS]), F.array_repeat(n("score", m), len(EV.CLINICAL_DIMENSIONS))).alias(side) for side, m in (("a", 7), ("b", 5))])
    flags = F.struct(F.when(n("flag", 9) > 0, True).alias("a"), F.lit(False).alias("b"))
    x = j.withColumn("ok", EV.valid_clinical_judgment(F.col("decision"), scores, flags, F.col("reason")))
    return x.groupBy("decision").agg(rows_as("n"), F.count_if("ok").alias("valid"))


@query(f"""WITH q AS ({core._EXAM}), x AS (SELECT *, array_to_string(list_sort(map_keys(choices)), '') AS keys FROM q), raw AS (SELECT count(*) AS n, count(DISTINCT id) AS ids FROM exam_question WHERE id IS NOT NULL)
SELECT (SELECT n FROM raw) AS questions, (SELECT n - ids FROM raw) AS duplicate_question_ids, count(*) FILTER (choices IS NULL OR question IS NULL OR question_type IS NULL OR exam_type IS NULL OR exam_class IS NULL OR exam_subject IS NULL) AS missing_fields, count(*) FILTER (answer IS NULL) AS missing_answers,
count(*) FILTER (answer IS NOT NULL AND {core._NORM.format('upper(answer)')} IS NULL) AS invalid_answers, count(DISTINCT exam_type) AS exam_types, count(DISTINCT exam_class) AS exam_classes, count(DISTINCT question_type) AS question_types FROM x""")
def exam_checks(s: SparkSession, d: str) -> DataFrame:
    """One row: how many questions, repeated ids, missing fields and answers, answers that name no choice, and kinds of questions."""
    q = table(s, d, "exam_question").where("id is not null")
    raw = q.agg(rows_as("questions"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicate_question_ids"))
    first = exam.first_rows(q).join(exam.questions(q).select("id", "gold"), "id")
    gone = F.lit(False)
    for c in ("choices", "question", "question_type", "exam_type", "exam_class", "exam_subject"):
        gone = gone | F.col(c).isNull()
    x = first.agg(F.count_if(gone).alias("missing_fields"), F.count_if(F.col("answer").isNull()).alias("missing_answers"), F.count_if(F.col("answer").isNotNull() & F.col("gold").isNull()).alias("invalid_answers"), *[F.count_distinct(c).alias(f"{c}s" if c != "exam_class" else "exam_classes") for c in ("exam_type", "exam_class", "question_type")])
    return raw.crossJoin(x)  # one row each


def _runs(name: str) -> str:
    return f"SELECT '{name}' AS model, question_type, exam_class, correct, answer IS NULL AS invalid FROM ({core._sql_scored(name)})"


@query(f"""WITH x AS ({_runs('m1')} UNION ALL {_runs('m2')} UNION ALL {_runs('m3')}), k AS (SELECT model, exam_class, count(*) FILTER (correct) / count(*) AS acc FROM x GROUP BY ALL), m AS (SELECT model, avg(acc) AS macro FROM k GROUP BY model),
a AS (SELECT model, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(*) AS accuracy, count(*) FILTER (correct AND question_type = '单项选择题') / nullif(count(*) FILTER (question_type = '单项选择题'), 0) AS single_choice, count(*) FILTER (correct AND question_type = 'C型选择题') / nullif(count(*) FILTER (question_type = 'C型选择题'), 0) AS c_type, count(*) FILTER (invalid) AS invalid_predictions FROM x GROUP BY model)
SELECT model, correct, total, round(accuracy, 6) AS accuracy, round(accuracy - (SELECT accuracy FROM a WHERE model = 'm1'), 6) AS delta_vs_base, round(macro, 6) AS macro_accuracy, round(single_choice, 6) AS single_choice, round(c_type, 6) AS c_type, invalid_predictions FROM a JOIN m USING (model)""")
def scorecard(s: SparkSession, d: str) -> DataFrame:
    """One row a system: accuracy, distance to the base system, mean over classes, accuracy by question type (null where there are none) and outputs without an answer."""
    x = None
    for name in ("m1", "m2", "m3"):
        one = core._scored(s, d, name).select(F.lit(name).alias("model"), "question_type", "exam_class", "correct", F.col("answer").isNull().alias("invalid"))
        x = one if x is None else x.unionByName(one)
    return exam.scorecard(x, "m1", {"single_choice": "单项选择题", "c_type": "C型选择题"})


_LOG = """WITH state AS (SELECT judge_model, list({'step': attempt, 'eval_loss': loss, 'eval_rewards/accuracies': acc, 'eval_rewards/margins': margin}) AS log_history FROM (SELECT * REPLACE (CASE WHEN attempt % 2 = 1 THEN loss END AS loss) FROM (SELECT judge_model, attempt, round(avg(parsed_judgment.confidence) FILTER (NOT isnan(parsed_judgment.confidence)), 6) AS loss, round(count(*) FILTER (status = 'ok') / count(*), 6) AS acc, count(*) AS margin FROM judgment GROUP BY ALL)) GROUP BY judge_model)"""


@query(_LOG + """, history AS (SELECT judge_model, entry FROM state, UNNEST(log_history) AS t(entry)) SELECT judge_model, entry.step AS step, entry.eval_loss AS eval_loss, entry."eval_rewards/accuracies" AS preference_accuracy, entry."eval_rewards/margins" AS reward_margin FROM history WHERE entry.eval_loss IS NOT NULL ORDER BY judge_model, step""")
def training_log(s: SparkSession, d: str) -> DataFrame:
    """Entries of a nested log with odd field names that have a loss, by model and step; the log is made of the judgments."""
    q = F.col("parsed_judgment.confidence")
    x = table(s, d, "judgment").groupBy("judge_model", "attempt").agg(F.round(F.avg(F.when(~F.isnan(q), q)), 6).alias("loss"), F.round(F.count_if(F.col("status") == "ok") / F.count(F.lit(1)), 6).alias("acc"), F.count(F.lit(1)).alias("margin"))
    entry = F.struct(F.col("attempt").alias("step"), F.when(F.col("attempt") % 2 == 1, F.col("loss")).alias("eval_loss"), F.col("acc").alias("eval_rewards/accuracies"), F.col("margin").alias("eval_rewards/margins"))
    h = x.groupBy("judge_model").agg(F.collect_list(entry).alias("log_history")).select("judge_model", F.explode("log_history").alias("entry"))  # one entry an attempt
    out = h.where("entry.eval_loss is not null").select("judge_model", "entry.step", "entry.eval_loss", F.col("entry.`eval_rewards/accuracies`").alias("preference_accuracy"), F.col("entry.`eval_rewards/margins`").alias("reward_margin"))
    return out.orderBy("judge_model", "step")


@query("""WITH export_stats AS (SELECT {'train': count(*) FILTER (split = 'train'), 'validation': count(*) FILTER (split = 'validation')} AS exported, {'train': {'accepted': count(*) FILTER (split = 'train' AND validation_status = 'accepted'), 'review': count(*) FILTER (split = 'train' AND validation_status = 'review')}} AS statuses FROM audited)
SELECT exported.train AS train_rows, exported.validation AS validation_rows, statuses.train.accepted AS train_accepted, statuses.train.review AS train_review FROM export_stats""")
def export_mix(s: SparkSession, d: str) -> DataFrame:
    """Counts of a nested statistics record by dotted names."""
    n = lambda split, status=None: F.count_if((F.col("split") == split) & (F.lit(True) if status is None else F.col("validation_status") == status))
    stats = table(s, d, "audited").agg(F.struct(n("train").alias("train"), n("validation").alias("validation")).alias("exported"), F.struct(F.struct(n("train", "accepted").alias("accepted"), n("train", "review").alias("review")).alias("train")).alias("statuses"))
    return stats.selectExpr("exported.train as train_rows", "exported.validation as validation_rows", "statuses.train.accepted as train_accepted", "statuses.train.review as train_review")


def _quoted(c: str) -> str:
    return f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"


@query(f"""SELECT source_id, '{PM.OPENINGS["teacher"]}' || '{{' || chr(10) || '  "task_type_hint": ' || {_quoted('task_type_hint')} || ',' || chr(10) || '  "case_text": ' || {_quoted('case_text')} || ',' || chr(10) || '  "original_answer": ' || {_quoted('original_answer')} || chr(10) || '}}' AS prompt
FROM (SELECT * FROM candidate WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY loaded_at, source_file, source_line) = 1)""")
def teacher_prompts(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "candidate").where("source_id is not null").select("source_id", "task_type_hint", "case_text", "original_answer", "loaded_at", "source_file", "source_line")
    return PM.teacher_prompts(sampling.keep_first(c, ["source_id"], F.col("loaded_at"), F.col("source_file"), F.col("source_line")), "source_id")
