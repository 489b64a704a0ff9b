"""Queries from audited sources to exported preference rows, each with SQL. Model answers and winners are stand-ins made by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import hashing as H
from lodestream.operators import audit as AU
from lodestream.operators import pairs as PR
from lodestream.operators import preference as P
from lodestream.operators import risk
from lodestream.plans import core
from lodestream.plans.core import Query, rows_as
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


LIMITS = {"train": 400, "validation": 60}
_LIMIT = "CASE split " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items()) + " END"
_SHARE = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PR.LEVEL_SHARES.items()) + " ELSE 0.0 END"
_n = lambda *parts: core._HEAD.format("'42:' || " + " || ':' || ".join(parts))
_SOUND = f"""SELECT source_id, split, category, case_text, target, warnings, target.clinical_reasoning || chr(10) || target.final_answer AS written FROM ({core._AUDIT} SELECT * FROM audit WHERE status <> 'rejected' AND case_text IS NOT NULL)"""
_SELECTED = f"""WITH sound AS ({_SOUND}), eligible AS (SELECT source_id, split, risk, coalesce(target.evidence_sufficiency, 'None') AS level, target.task_type AS task_type FROM (WITH a AS (SELECT source_id, split, target, warnings, case_text, written FROM sound), {core._RISK_RULES} SELECT source_id, split, target, level AS risk FROM target_risk) WHERE risk <> 'high' AND split IN ('train', 'validation')),
s1 AS (SELECT *, least({_LIMIT}, count(*) OVER (PARTITION BY split)) AS aim, row_number() OVER (PARTITION BY split, risk ORDER BY {_n('source_id', "'medium-risk'")}, source_id) AS m FROM eligible),
s2 AS (SELECT *, least(aim, count(*) OVER (PARTITION BY split)) AS aim2 FROM s1 WHERE risk <> 'medium' OR m <= floor(aim * 0.15)),
s3 AS (SELECT *, least(count(*) OVER (PARTITION BY split, level), round_even(aim2 * {_SHARE}, 0)) AS quota, row_number() OVER (PARTITION BY split, level, task_type ORDER BY {_n('source_id')}, source_id) AS turn, {_n("array_to_string(string_split(coalesce(task_type, 'None'), ''), ':')")} AS kind FROM s2),
s4 AS (SELECT *, row_number() OVER (PARTITION BY split, level ORDER BY turn, kind, task_type) <= quota AS chosen FROM s3),
s5 AS (SELECT *, aim2 - sum(CAST(chosen AS INT)) OVER (PARTITION BY split) AS room, row_number() OVER (PARTITION BY split, chosen ORDER BY {_n('source_id', "'fill'")}, source_id) AS fill FROM s4),
selected AS (SELECT source_id, split, level, task_type, risk FROM s5 WHERE chosen OR fill <= room)"""


def _sound(s: SparkSession, d: str) -> DataFrame:
    """Targets without an audit error, with their case and the warnings of the audit."""
    x = AU.audit(table(s, d, "audited"), table(s, d, "candidate"), copies=False).where("status <> 'rejected' and case_text is not null")
    return materialize(x.select("source_id", "split", "category", "case_text", "target", "warnings"), "sound-targets")


def _selected(sound: DataFrame) -> DataFrame:
    x = sound.withColumn("risk", risk.target_risk(F.col("case_text"), F.col("target"), F.col("warnings"))["level"])
    x = x.where("risk <> 'high'").select("source_id", "split", "risk", F.coalesce("target.evidence_sufficiency", F.lit("None")).alias("level"), "target.task_type")
    return PR.select_sources(materialize(x, "eligible"), LIMITS)


@query(_SELECTED + " SELECT * FROM selected")
def selected_sources(s: SparkSession, d: str) -> DataFrame:
    return _selected(_sound(s, d))


@query(_SELECTED + " SELECT split, level, task_type, risk, count(*) AS n FROM selected GROUP BY ALL")
def selection_report(s: SparkSession, d: str) -> DataFrame:
    return selected_sources(s, d).groupBy("split", "level", "task_type", "risk").agg(rows_as("n"))


_TYPE = "STRUCT(missing_information VARCHAR[], clinical_reasoning VARCHAR, final_answer VARCHAR)"
_ANSWERS = f"""SELECT source_id, 'm' || no AS candidate_id, no, CAST(CASE no WHEN 1 THEN {{'missing_information': target.missing_information, 'clinical_reasoning': target.clinical_reasoning || '建议结合复查结果判断。', 'final_answer': target.final_answer || '请按时复诊。'}}
WHEN 2 THEN {{'missing_information': ['既往检查结果'], 'clinical_reasoning': target.clinical_reasoning, 'final_answer': target.final_answer || '如有不适随时就医。'}} WHEN 3 THEN {{'missing_information': target.missing_information, 'clinical_reasoning': target.clinical_reasoning, 'final_answer': CASE WHEN {_n('source_id', "'m3'")} % 2 = 0 THEN target.final_answer ELSE '多喝水。' END}}
WHEN 4 THEN {{'missing_information': target.missing_information, 'clinical_reasoning': target.clinical_reasoning || '建议结合复查结果判断。', 'final_answer': target.final_answer || '请按时复诊。'}} ELSE {{'missing_information': [' '], 'clinical_reasoning': '', 'final_answer': '37.5℃ 服药 250mg'}} END AS {_TYPE}) AS answer FROM (SELECT *, unnest(range(1, 6)) AS no FROM src)"""


def _laid(answer: str) -> str:
    return f"{{'task_type': target.task_type, 'query_intent': target.query_intent, 'evidence_sufficiency': target.evidence_sufficiency, 'evidence': target.evidence, 'critical_evidence_ids': target.critical_evidence_ids, 'missing_information': {answer}.missing_information, 'clinical_reasoning': {answer}.clinical_reasoning, 'final_answer': {answer}.final_answer}}"


def _issues(rows: str, *keep: str) -> str:
    """Audit codes of targets of any table with source_id, case_text and target, record rules left out."""
    t = f"SELECT *, 1 AS times, true AS known, split AS csplit, 'x' AS category, 'x' AS ccategory, 'x' AS teacher_model, target.task_type AS hint FROM ({rows})"
    return f"(WITH t AS ({t}), {core._ISSUES.rstrip().rstrip(',')} SELECT {', '.join(keep)}, errors, review, warnings FROM i)"


_NEGATIVE = "CASE defect " + " ".join(
    f"WHEN '{k}' THEN {{'missing_information': {'target.missing_information' if m is None else (str(m) if m else 'CAST([] AS VARCHAR[])')}, 'clinical_reasoning': '{r}', 'final_answer': '{a}'}}" for k, (m, r, a) in P.NEGATIVES.items()
) + " END"
_DIFF = "list_filter([CASE WHEN {0}.missing_information IS DISTINCT FROM {1}.missing_information THEN 'missing_information' END, CASE WHEN {0}.clinical_reasoning IS DISTINCT FROM {1}.clinical_reasoning THEN 'clinical_reasoning' END, CASE WHEN {0}.final_answer IS DISTINCT FROM {1}.final_answer THEN 'final_answer' END], lambda x: x IS NOT NULL)"
_RAW = f"SELECT a.source_id, split, case_text, candidate_id, no, answer, {_laid('answer')} AS target, answer.missing_information IS NOT DISTINCT FROM target.missing_information AS same FROM ans a JOIN src ON a.source_id = src.source_id WHERE len(list_filter(answer.missing_information, lambda m: m IS NULL OR trim(m) = '')) = 0 AND trim(answer.clinical_reasoning) <> '' AND trim(answer.final_answer) <> '' AND answer.missing_information IS NOT NULL AND len({_DIFF.format('target', 'answer')}) > 0"
_CTRL = f"SELECT source_id, split, case_text, defect, {_laid('neg')} AS target FROM (SELECT *, {_NEGATIVE} AS neg FROM (SELECT *, CASE WHEN {_n('source_id', chr(39) + 'controlled' + chr(39))} % 2 = 0 THEN CASE WHEN target.evidence_sufficiency = 'sufficient' THEN 'unnecessary_uncertainty' ELSE 'overconfident_answer' END ELSE 'generic_non_answer' END AS defect FROM src))"
_BUILT = _SELECTED + f""", src AS (SELECT source_id, split, case_text, target FROM sound WHERE source_id IN (SELECT source_id FROM selected)), ans AS ({_ANSWERS}),
proj AS (SELECT *, len(review) + len(warnings) AS n_warn FROM {_issues(_RAW, 'source_id', 'split', 'candidate_id', 'no', 'target', 'same')} WHERE len(errors) = 0),
models AS (SELECT * FROM proj QUALIFY row_number() OVER (PARTITION BY source_id, target.missing_information, target.clinical_reasoning, target.final_answer ORDER BY no, candidate_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n_warn = 0, same, -n_warn, {_n("'answer_rank_tie'", 'source_id', 'candidate_id')}) AS low, count(*) OVER (PARTITION BY source_id) AS n FROM models),
neg AS (SELECT * FROM {_issues(_CTRL, 'source_id', 'split', 'defect', 'target')} WHERE len(errors) = 0),
made AS (SELECT s.source_id, s.split, 'target_vs_model' AS pair_type, 'validated_target' AS xi, s.target AS xr, r.candidate_id AS yi, r.target AS yr FROM src s JOIN ranked r ON s.source_id = r.source_id AND r.low = 1
 UNION ALL SELECT b.source_id, b.split, 'model_vs_model', b.candidate_id, b.target, w.candidate_id, w.target FROM ranked b JOIN ranked w ON b.source_id = w.source_id AND b.low = b.n AND w.low = 1 WHERE b.n >= 2
 UNION ALL SELECT s.source_id, s.split, 'controlled_negative', 'validated_target', s.target, 'controlled_' || defect, neg.target FROM src s JOIN neg ON s.source_id = neg.source_id),
named AS (SELECT *, 'pair_' || substr(sha256('42:' || source_id || ':' || pair_type || ':' || xi || ':' || yi), 1, 16) AS pair_id, array_to_string({_DIFF.format('xr', 'yr')}, ',') AS difference_fields FROM made WHERE len({_DIFF.format('xr', 'yr')}) > 0),
built AS (SELECT *, {_n('pair_id', "'blind_position'")} % 2 = 0 AS x_first FROM named)"""  # fmt: skip


def _sources(s: SparkSession, d: str) -> DataFrame:
    x = _sound(s, d)
    return materialize(x.join(_selected(x).select("source_id"), "source_id").select("source_id", "split", "case_text", "target"), "sources")


def _built(src: DataFrame) -> DataFrame:
    t = lambda f: F.col(f"target.{f}")
    answer = lambda m, r, a: F.struct(m.cast("array<string>").alias("missing_information"), r.alias("clinical_reasoning"), a.alias("final_answer"))
    more = lambda f, x: F.concat(t(f), F.lit(x))
    first = answer(t("missing_information"), more("clinical_reasoning", "建议结合复查结果判断。"), more("final_answer", "请按时复诊。"))
    third = F.when(H.stable_number(F.col("source_id"), "m3") % 2 == 0, t("final_answer")).otherwise("多喝水。")
    options = F.array(
        first, answer(F.array(F.lit("既往检查结果")), t("clinical_reasoning"), more("final_answer", "如有不适随时就医。")), answer(t("missing_information"), t("clinical_reasoning"), third), first,
        answer(F.array(F.lit(" ")), F.lit(""), F.lit("37.5℃ 服药 250mg")),
    )
    c = src.select("source_id", F.posexplode(options).alias("no", "answer")).select("source_id", F.concat(F.lit("m"), (F.col("no") + 1).cast("string")).alias("candidate_id"), "no", "answer")
    return materialize(PR.build_pairs(src, c), "pairs")


@query(_BUILT + " SELECT pair_id, pair_type, source_id, split, difference_fields, CASE WHEN x_first THEN xi ELSE yi END AS candidate_a, CASE WHEN x_first THEN yi ELSE xi END AS candidate_b FROM built")
def built_pairs(s: SparkSession, d: str) -> DataFrame:
    return _built(_sources(s, d)).select("pair_id", "pair_type", "source_id", "split", F.array_join("difference_fields", ",").alias("difference_fields"), "candidate_a", "candidate_b")


@query(_BUILT + " SELECT split, pair_type, count(*) AS pairs, count(DISTINCT source_id) AS sources FROM built GROUP BY ALL")
def pair_report(s: SparkSession, d: str) -> DataFrame:
    return _built(_sources(s, d)).groupBy("split", "pair_type").agg(rows_as("pairs"), F.count_distinct("source_id").alias("sources"))


def _json(t: str) -> str:
    return f"CAST(to_json({{'task_type': {t}.task_type, 'query_intent': {t}.query_intent, 'evidence_sufficiency': {t}.evidence_sufficiency, 'evidence': list_transform({t}.evidence, lambda e: {{'id': e.id, 'span': e.span, 'importance': e.importance, 'role': e.role}}), 'critical_evidence_ids': {t}.critical_evidence_ids, 'missing_information': {t}.missing_information, 'clinical_reasoning': {t}.clinical_reasoning, 'final_answer': {t}.final_answer}}) AS VARCHAR)"


@query(_BUILT + f""", won AS (SELECT *, CASE WHEN x_first THEN xr ELSE yr END AS ra, CASE WHEN x_first THEN yr ELSE xr END AS rb, CASE {_n('pair_id', "'judge'")} % 5 WHEN 0 THEN 'b' WHEN 1 THEN NULL ELSE 'a' END AS winner FROM built)
SELECT '{PR.SCHEMA_VERSION}' AS schema_version, '{PR.SCOPE}' AS preference_scope, won.source_id, pair_id, '请根据病例回答：' || src.case_text AS prompt, CASE winner WHEN 'a' THEN {_json('ra')} ELSE {_json('rb')} END AS chosen, CASE winner WHEN 'a' THEN {_json('rb')} ELSE {_json('ra')} END AS rejected,
pair_type, difference_fields, winner AS position FROM won JOIN src ON won.source_id = src.source_id WHERE winner IS NOT NULL""")
def exported_rows(s: SparkSession, d: str) -> DataFrame:
    """Chosen and rejected rows of the built pairs; the winner is a stand-in by hash, every fifth pair has none."""
    return _exported(_sources(s, d))


def _exported(src: DataFrame) -> DataFrame:
    p = _built(src)
    k = H.stable_number(F.col("pair_id"), "judge") % 5
    w = p.select("pair_id", F.when(k == 0, "b").when(k != 1, "a").alias("winner"))
    prompts = src.select("source_id", F.concat(F.lit("请根据病例回答："), "case_text").alias("prompt"))
    return PR.export_rows(p, w, prompts).withColumn("difference_fields", F.array_join("difference_fields", ","))


@query(_BUILT + f""", won AS (SELECT *, length({_json('xr')}) AS lx, length({_json('yr')}) AS ly, CASE {_n('pair_id', "'judge'")} % 5 WHEN 0 THEN 'b' WHEN 1 THEN NULL ELSE 'a' END AS winner FROM built), l AS (SELECT split, pair_type, source_id, winner, CASE WHEN (winner = 'a') = x_first THEN lx > ly ELSE ly > lx END AS longer FROM won WHERE winner IS NOT NULL),
t AS (SELECT split, max(n) AS most FROM (SELECT split, source_id, count(*) AS n FROM l GROUP BY ALL) GROUP BY split)
SELECT split, count(*) AS "rows", count(DISTINCT source_id) AS sources, max(most) AS most_per_source, count(*) FILTER (longer) AS chosen_longer, round_even(count(*) FILTER (longer) / count(*), 6) AS chosen_longer_rate, round_even(count(*) FILTER (winner = 'a') / count(*), 6) AS a_rate FROM l JOIN t USING (split) GROUP BY split""")
def export_report(s: SparkSession, d: str) -> DataFrame:
    """Per split: exported rows, sources, most rows of a source, how often the chosen text is longer, and how often a won."""
    src = _sources(s, d)
    x = materialize(_exported(src).join(src.select("source_id", "split"), "source_id"), "exported")
    most = x.groupBy("split", "source_id").count().groupBy("split").agg(F.max("count").alias("most_per_source"))
    longer, n = F.count_if(F.length("chosen") > F.length("rejected")), F.count(F.lit(1))
    g = x.groupBy("split").agg(rows_as("rows"), F.count_distinct("source_id").alias("sources"), longer.alias("chosen_longer"), F.bround(longer / n, 6).alias("chosen_longer_rate"), F.bround(F.count_if(F.col("position") == "a") / n, 6).alias("a_rate"))
    return g.join(most, "split").select("split", "rows", "sources", "most_per_source", "chosen_longer", "chosen_longer_rate", "a_rate")
