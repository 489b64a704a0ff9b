"""Queries over the core operators, each with equivalent SQL where SQL can express it. All run over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import arrays as A
from lodestream.functions import hashing as H
from lodestream.functions import jsonx, stats
from lodestream.functions import text as T
from lodestream.operators import audit as AU
from lodestream.operators import chat, clinical, exam, joins, masking, records, retrieval, risk, sampling
from lodestream.operators import preference as P
from lodestream.session import table
from lodestream.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def rows_as(name: str) -> Column:
    return F.count(F.lit(1)).cast("bigint").alias(name)


def big(c: Column) -> Column:
    return c.cast("bigint")


# SQL fragments -------------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '^[\s\x{{3000}}\x{{00a0}}]+|[\s\x{{3000}}\x{{00a0}}]+$', '', 'g')"
_HEAD = "CAST('0x' || substr(sha256({0}), 1, 16) AS UBIGINT)"


def _any(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def _count(col: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{t}') AS INT)" for t in terms) + ")"


_TASK = f"CASE WHEN {_any('case_text', T.CONFIRMED)} OR {_count('case_text', T.MANAGEMENT)} > {_count('case_text', T.DIAGNOSTIC)} THEN 'confirmed_management' ELSE 'diagnostic_reasoning' END"
_DEPARTMENT = T.DEPARTMENT.replace("'", "''")
_CASE = f"CASE WHEN regexp_matches(case_text, '{_DEPARTMENT}') THEN {_STRIP.format(f"substr(case_text, length(regexp_extract(case_text, '{_DEPARTMENT}')) + 1)")} ELSE {_STRIP.format('case_text')} END"
_LATEST = "SELECT source_id, case_text, original_answer, category, split, loaded_at FROM candidate WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY loaded_at, source_file, source_line) = 1"
_SIGNS = f"{_any('case_text', T.PATIENT)} AS p, {_any('case_text', T.SYMPTOM)} AS s, {_any('case_text', T.EXAM)} AS e, {_any('case_text', T.TIME)} AS t, {_any('case_text', T.QUESTION)} AS q"
_MINED = f"""
WITH c0 AS ({_LATEST}), c AS (SELECT * REPLACE ({_CASE} AS case_text) FROM c0), g AS (SELECT *, {_SIGNS} FROM c WHERE case_text IS NOT NULL AND original_answer IS NOT NULL), x AS (
  SELECT *, CASE WHEN length(case_text) < 35 OR length(case_text) > 1800 THEN 'question_length_out_of_range'
    WHEN length({_STRIP.format('original_answer')}) < 20 THEN 'answer_too_short'
    WHEN regexp_matches(case_text, '{T.KNOWLEDGE_ONLY}') AND NOT (p OR e) THEN 'knowledge_only_question'
    WHEN regexp_matches(case_text, '{T.PROVIDER}') THEN 'provider_recommendation_question'
    WHEN NOT q THEN 'missing_clinical_question_intent' WHEN NOT (p OR s OR e) THEN 'missing_case_evidence' END AS exit_reason,
    2 * CAST(p AS INT) + 2 * CAST(s AS INT) + 2 * CAST(e AS INT) + CAST(t AS INT) + CAST(q AS INT) + CAST(length(case_text) >= 80 AS INT) + CAST(length(original_answer) >= 80 AS INT) AS points FROM g)
SELECT source_id, CAST(CASE WHEN exit_reason IS NULL THEN points ELSE 0 END AS BIGINT) AS score,
  CASE WHEN exit_reason IS NOT NULL THEN exit_reason ELSE concat_ws(',', CASE WHEN p THEN 'patient_context' END, CASE WHEN s THEN 'symptom_context' END, CASE WHEN e THEN 'exam_context' END,
    CASE WHEN t THEN 'temporal_context' END, CASE WHEN q THEN 'clinical_question' END, CASE WHEN length(case_text) >= 80 THEN 'detailed_case' END, CASE WHEN length(original_answer) >= 80 THEN 'usable_reference_answer' END) END AS reasons,
  {_TASK} AS task_type, CAST({_HEAD.format("'42:' || source_id")} % 100 AS BIGINT) AS bucket,
  CASE WHEN {_HEAD.format("'42:' || source_id")} % 100 < 85 THEN 'train' WHEN {_HEAD.format("'42:' || source_id")} % 100 < 95 THEN 'validation' ELSE 'test' END AS new_split
FROM x
"""  # fmt: skip


def latest(s: SparkSession, d: str) -> DataFrame:
    """One candidate row a non-null source_id: the one loaded first."""
    c = table(s, d, "candidate").where("source_id is not null").select("source_id", "case_text", "original_answer", "category", "split", "loaded_at", "source_file", "source_line")
    return sampling.keep_first(c, ["source_id"], F.col("loaded_at"), F.col("source_file"), F.col("source_line")).drop("source_file", "source_line")


# Mining --------------------------------------------------------------------------------------------------------------


@query(_MINED)
def mine_candidates(s: SparkSession, d: str) -> DataFrame:
    x = latest(s, d).where("case_text is not null and original_answer is not null").withColumn("case_text", T.split_department(F.col("case_text"))[1])
    score, reasons = T.score_case(F.col("case_text"), F.col("original_answer"))
    b = H.bucket(F.col("source_id"))
    return x.select("source_id", big(score).alias("score"), F.array_join(reasons, ",").alias("reasons"), T.classify_task(F.col("case_text")).alias("task_type"), big(b).alias("bucket"), H.assign_split(b).alias("new_split"))


@query(f"WITH m AS ({_MINED}) SELECT CASE WHEN score = 0 THEN reasons WHEN score < 6 THEN 'score_below_threshold' ELSE 'accepted' END AS outcome, count(*) AS n FROM m GROUP BY 1")
def mining_outcomes(s: SparkSession, d: str) -> DataFrame:
    why = F.when(F.col("score") == 0, F.col("reasons")).when(F.col("score") < 6, "score_below_threshold").otherwise("accepted")
    return mine_candidates(s, d).groupBy(why.alias("outcome")).agg(rows_as("n"))


@query(f"WITH m AS ({_MINED}) SELECT task_type, new_split, count(*) AS n FROM m GROUP BY ALL")
def mined_by_split(s: SparkSession, d: str) -> DataFrame:
    return mine_candidates(s, d).groupBy("task_type", "new_split").agg(rows_as("n"))


@query()
def canonical_ids(s: SparkSession, d: str) -> DataFrame:
    """Content ids of canonical texts (NFKC, which SQL lacks), first row of each kept."""
    x = table(s, d, "candidate").where("case_text is not null").select("source_id", "loaded_at", T.canonical(F.col("case_text")).alias("canon"))
    x = x.where("canon <> ''").withColumn("content_id", H.content_id("case", F.col("canon"))).drop("canon")
    return sampling.keep_first(x, ["content_id"], F.col("loaded_at"), F.col("source_id")).select("content_id", "source_id")


@query("SELECT doc_id, 'doc_' || substr(sha256('42:' || doc_id || ':' || lang), 1, 16) AS stable_id, sha256('42:' || doc_id) AS order_key, CAST(" + _HEAD.format("doc_id || chr(31) || 'position' || chr(31) || '42'") + " % 2 = 0 AS BOOLEAN) AS even_tail FROM documents")
def stable_ids(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", H.stable_id("doc", i, F.col("lang")).alias("stable_id"), H.order_key(i).alias("order_key"), ((H.stable_number_tail(i, "position") % 2) == 0).alias("even_tail"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_wins(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return x.groupBy("h").agg(F.min("doc_id").alias("doc_id"), rows_as("copies")).drop("h")


_LASTJ = "SELECT * FROM judgment WHERE pair_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY created_at DESC NULLS LAST, loaded_at DESC NULLS LAST, attempt DESC NULLS LAST, status DESC NULLS LAST) = 1"


@query(f"WITH l AS ({_LASTJ}) SELECT pair_id, created_at, status FROM l")
def last_wins(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "judgment").where("pair_id is not null").select("pair_id", "created_at", "loaded_at", "attempt", "status")
    return sampling.keep_last(x, ["pair_id"], F.col("created_at"), F.col("loaded_at"), F.col("attempt"), F.col("status")).select("pair_id", "created_at", "status")


@query("""WITH l AS (SELECT * FROM judgment WHERE pair_id IS NOT NULL), f AS (
  SELECT pair_id, max(created_at) AS last_failed FROM l WHERE status <> 'ok' AND NOT EXISTS (SELECT 1 FROM l AS o WHERE o.pair_id = l.pair_id AND o.status = 'ok') GROUP BY pair_id)
SELECT pair_id, last_failed FROM f""")
def compacted_failures(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "judgment").where("pair_id is not null").select("pair_id", "created_at", "status")
    out = incremental.compact_failures(j.where("status <> 'ok'"), j.where("status = 'ok'"), "pair_id", "created_at")
    return out.select("pair_id", F.col("created_at").alias("last_failed"))


# Quotas and samples --------------------------------------------------------------------------------------------------

_D = "(SELECT doc_id, coalesce(category, 'none') AS category FROM documents)"


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("category", F.lit("none")).alias("category"))


_CAP = f"SELECT doc_id, category FROM (SELECT *, sha256('42:' || doc_id) AS k FROM {_D} QUALIFY row_number() OVER (PARTITION BY category ORDER BY k) <= 20) ORDER BY k LIMIT 300"


@query(_CAP)
def category_cap(s: SparkSession, d: str) -> DataFrame:
    return sampling.category_cap(docs(s, d), "category", "doc_id", 300, 20)


@query(f"""WITH a AS ({_CAP.replace('LIMIT 300', 'LIMIT 900')}), b AS (SELECT doc_id, category FROM {_D} WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY sha256('43:' || doc_id) LIMIT (SELECT greatest(0, 900 - count(*)) FROM a))
SELECT doc_id, category, 'capped' AS origin FROM a UNION ALL SELECT doc_id, category, 'backfill' AS origin FROM b""")
def capped_backfill(s: SparkSession, d: str) -> DataFrame:
    return sampling.capped_with_backfill(docs(s, d), "category", "doc_id", 900, 20)


@query(f"""WITH g AS (SELECT category, row_number() OVER (ORDER BY sha256('42:' || category)) AS group_rank FROM (SELECT DISTINCT category FROM {_D})),
t AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY {_HEAD.format("'42:' || doc_id")}, doc_id) AS turn FROM {_D})
SELECT doc_id, category, turn, group_rank FROM t JOIN g USING (category)""")
def round_robin(s: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(docs(s, d), "category", "doc_id").select("doc_id", "category", big(F.col("turn")).alias("turn"), big(F.col("group_rank")).alias("group_rank"))


_QUOTA = f"""SELECT category, size, CAST(CASE WHEN total <= 240 THEN size ELSE least(size, base + CAST(row_number() OVER (ORDER BY exact - base DESC, category) <= 240 - sum(base) OVER () AS INT)) END AS BIGINT) AS quota FROM (
  SELECT category, size, total, 240 * size / total AS exact, floor(240 * size / total) AS base FROM (SELECT category, count(*) AS size, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM {_D} GROUP BY category))"""


@query(_QUOTA)
def remainder_quotas(s: SparkSession, d: str) -> DataFrame:
    return sampling.remainder_quotas(docs(s, d), "category", 240)


@query(f"WITH q AS ({_QUOTA}), n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM {_D}) SELECT doc_id, category FROM n JOIN q USING (category) WHERE rn <= quota")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(docs(s, d), "category", "doc_id", 240)


@query("""WITH w AS (SELECT * FROM (VALUES ('target_vs_model', 0.55), ('model_vs_model', 0.35), ('controlled_negative', 0.1)) AS t(name, w)), q AS (SELECT *, 1054 * w AS exact, floor(1054 * w + 1e-9) AS base FROM w)
SELECT name, CAST(base + CAST(row_number() OVER (ORDER BY round(exact - base, 9) DESC, w DESC, name DESC) <= 1054 - sum(base) OVER () AS INT) AS BIGINT) AS quota FROM q""")
def type_quotas(s: SparkSession, d: str) -> DataFrame:
    w = s.createDataFrame([("target_vs_model", 0.55), ("model_vs_model", 0.35), ("controlled_negative", 0.1)], "name string, weight double")
    return sampling.weight_quotas(w, 1054)


@query(f"SELECT doc_id, source FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_HEAD.format(chr(39) + '42:' + chr(39) + ' || doc_id || ' + chr(39) + ':pick' + chr(39))}, doc_id) <= 5")
def top_by_hash(s: SparkSession, d: str) -> DataFrame:
    return sampling.top_by_hash(table(s, d, "documents").where("source is not null").select("doc_id", "source"), "source", "doc_id", 5, "pick")


@query(f"""WITH t AS (SELECT source_id, max(target.evidence_sufficiency) AS level FROM audited WHERE source_id IS NOT NULL GROUP BY source_id), w AS (SELECT * FROM (VALUES ('partial', 0.55), ('insufficient', 0.25), ('sufficient', 0.19), ('conflicting', 0.01)) v(level, w)),
n AS (SELECT t.*, coalesce(round_even((SELECT least(400, count(*)) FROM t) * w.w, 0), 0) AS quota, row_number() OVER (PARTITION BY t.level ORDER BY {_HEAD.format("'42:' || source_id || ':pick'")}, source_id) AS rn FROM t LEFT JOIN w USING (level)),
a AS (SELECT source_id, level, 'quota' AS how FROM n WHERE rn <= quota), b AS (SELECT source_id, level, 'fill' AS how FROM n WHERE rn > quota ORDER BY {_HEAD.format("'42:' || source_id || ':fill'")}, source_id LIMIT (SELECT greatest(0, (SELECT least(400, count(*)) FROM t) - count(*)) FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def weighted_fill(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "audited").where("source_id is not null").groupBy("source_id").agg(F.max("target.evidence_sufficiency").alias("level"))
    return sampling.weighted_fill(x, "level", "source_id", 400, {"partial": 0.55, "insufficient": 0.25, "sufficient": 0.19, "conflicting": 0.01})


_CONF = "SELECT pair_id, split, parsed_judgment.confidence AS q FROM (" + _LASTJ + ") WHERE status = 'ok' AND parsed_judgment.confidence BETWEEN 0 AND 1 AND NOT isnan(parsed_judgment.confidence) AND split IS NOT NULL"


@query(f"""WITH r AS (SELECT pair_id, split, row_number() OVER (PARTITION BY split ORDER BY q DESC, pair_id) AS up, count(*) OVER (PARTITION BY split) AS n FROM ({_CONF}))
SELECT a.split, a.up AS pair_no, a.pair_id AS best, b.pair_id AS worst FROM r AS a JOIN r AS b ON a.split = b.split AND b.up = a.n - a.up + 1 WHERE 2 * a.up <= a.n""")
def best_with_worst(s: SparkSession, d: str) -> DataFrame:
    x = _last_judgments(s, d).where("status = 'ok' and split is not null").select("pair_id", "split", F.col("j.confidence").alias("q")).where(F.col("q").between(0.0, 1.0) & ~F.isnan("q"))
    return sampling.best_with_worst(x, "split", "pair_id", F.col("q")).select("split", big(F.col("pair_no")).alias("pair_no"), "best", "worst")


# Joins and sets ------------------------------------------------------------------------------------------------------


@query("SELECT source_id FROM candidate WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM audited WHERE source_id IS NOT NULL AND validation_status = 'accepted')")
def pending_requests(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "candidate").where("source_id is not null").select("source_id")
    return joins.pending(c, table(s, d, "audited"), "source_id", F.col("validation_status") == "accepted")


@query(f"""WITH c AS ({_LATEST}), a AS (SELECT source_id, max(split) AS split, max(category) AS category FROM audited GROUP BY source_id)
SELECT a.source_id, CASE WHEN c.source_id IS NULL THEN 'source_not_found' ELSE concat_ws(',', CASE WHEN a.split IS DISTINCT FROM c.split THEN 'split_mismatch' END, CASE WHEN a.category IS DISTINCT FROM c.category THEN 'category_mismatch' END) END AS issues
FROM a LEFT JOIN c ON a.source_id = c.source_id""")
def metadata_audit(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audited").groupBy("source_id").agg(F.max("split").alias("split"), F.max("category").alias("category"))
    x = joins.audited_join(a, latest(s, d).select("source_id", "split", "category"), "source_id", ["split", "category"])
    return x.select("source_id", F.array_join("issues", ",").alias("issues"))


@query("SELECT c.c_custkey, coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, 'CHANGED' AS c_mktsegment FROM customer WHERE c_acctbal < 0) n USING (c_custkey)")
def keyed_upsert(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return joins.upsert(c.select("c_custkey", "c_mktsegment"), c.where("c_acctbal < 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment")), "c_custkey")


@query("""SELECT source_id, 'left' AS side FROM (SELECT DISTINCT source_id FROM audited WHERE source_id IS NOT NULL EXCEPT SELECT source_id FROM candidate)
UNION ALL SELECT source_id, 'right' AS side FROM (SELECT DISTINCT source_id FROM candidate WHERE source_id IS NOT NULL EXCEPT SELECT source_id FROM audited)""")
def key_differences(s: SparkSession, d: str) -> DataFrame:
    a, c = (table(s, d, t).where("source_id is not null") for t in ("audited", "candidate"))
    return joins.key_differences(a, c, "source_id")


@query("SELECT c_custkey AS k, c_name AS name, NULL AS s_acctbal FROM customer UNION ALL SELECT -s_suppkey - 1, s_name, s_acctbal FROM supplier")
def merge_unique(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(s, d, "supplier").select((-F.col("s_suppkey") - 1).alias("k"), F.col("s_name").alias("name"), "s_acctbal")
    return joins.merge_unique([a, b], "k")


@query("SELECT DISTINCT category FROM audited WHERE split = 'train' AND category IN (SELECT category FROM audited WHERE split = 'test')")
def shared_categories(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audited")
    return joins.shared_keys(a.where("split = 'train'"), a.where("split = 'test'"), "category")


@query("SELECT source_id, count(*) AS n FROM candidate WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(*) > 1")
def repeated_sources(s: SparkSession, d: str) -> DataFrame:
    return joins.repeated_keys(table(s, d, "candidate").where("source_id is not null"), "source_id").select("source_id", big(F.col("rows")).alias("n"))


# Evidence ------------------------------------------------------------------------------------------------------------

_EV = f"""WITH c AS (SELECT source_id, max(case_text) AS case_text FROM candidate WHERE case_text IS NOT NULL GROUP BY source_id), a AS (SELECT DISTINCT source_id, target.evidence AS ev, target.critical_evidence_ids AS crit FROM audited WHERE target.evidence IS NOT NULL),
x AS (SELECT a.*, c.case_text FROM a JOIN c ON a.source_id = c.source_id)"""


def evidence(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "candidate").where("case_text is not null").groupBy("source_id").agg(F.max("case_text").alias("case_text"))
    a = table(s, d, "audited").select("source_id", F.col("target.evidence").alias("ev"), F.col("target.critical_evidence_ids").alias("crit")).where("ev is not null").distinct()
    return a.join(c, "source_id")


@query(_EV + """ SELECT source_id, CAST(len(list_filter(ev, lambda e: e.span IS NOT NULL)) AS BIGINT) AS spans, CAST(len(list_filter(ev, lambda e: e.span IS NOT NULL AND contains(case_text, e.span))) AS BIGINT) AS grounded,
CAST(len(list_filter(ev, lambda e: length(e.span) > 0 AND (length(case_text) - length(replace(case_text, e.span, ''))) / length(e.span) > 1)) AS BIGINT) AS ambiguous FROM x""")
def evidence_grounding(s: SparkSession, d: str) -> DataFrame:
    x = evidence(s, d)
    spans = A.spans_of(F.col("ev"))
    hits = F.filter(A.grounded(spans, F.col("case_text")), lambda b: b)
    twice = F.filter(spans, lambda t: T.occurrences(F.col("case_text"), t) > 1)
    return x.select("source_id", *[big(F.size(c)).alias(n) for c, n in ((spans, "spans"), (hits, "grounded"), (twice, "ambiguous"))])


@query("""WITH a AS (SELECT DISTINCT source_id, target.evidence AS ev FROM audited WHERE target.evidence IS NOT NULL), u AS (SELECT row_number() OVER () AS rid, source_id, ev FROM a),
s AS (SELECT rid, e.span_start AS a, e.span_end AS b FROM (SELECT rid, unnest(ev) AS e FROM u) WHERE e.span_start IS NOT NULL AND e.span_end IS NOT NULL),
o AS (SELECT rid, bool_or(nxt < b) AS hit FROM (SELECT rid, b, lead(a) OVER (PARTITION BY rid ORDER BY a, b) AS nxt FROM s) GROUP BY rid)
SELECT source_id, coalesce(hit, false) AS overlapping FROM u LEFT JOIN o USING (rid)""")
def overlapping_spans(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audited").select("source_id", F.col("target.evidence").alias("ev")).where("ev is not null").distinct()
    return a.select("source_id", A.overlapping(F.col("ev")).alias("overlapping"))


@query("""WITH a AS (SELECT DISTINCT source_id, target.evidence AS ev, coalesce(target.critical_evidence_ids, []) AS crit FROM audited WHERE target.evidence IS NOT NULL), b AS (
SELECT source_id, list_transform(ev, lambda e: e.id) AS ids, crit, list_transform(list_filter(ev, lambda e: e.importance = 'critical'), lambda e: e.id) AS marked FROM a)
SELECT source_id, len(list_distinct(ids)) = len(ids) AND len(list_distinct(crit)) = len(crit) AND len(list_filter(crit, lambda i: NOT list_contains(marked, i))) = 0 AND len(list_filter(marked, lambda i: NOT list_contains(crit, i))) = 0 AS consistent FROM b""")
def critical_consistency(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audited").select("source_id", F.col("target.evidence").alias("ev"), F.coalesce("target.critical_evidence_ids", F.array().cast("array<string>")).alias("crit")).where("ev is not null").distinct()
    return a.select("source_id", A.critical_consistent(F.col("ev"), F.col("crit")).alias("consistent"))


_PRED = "list_filter(spans, lambda x: ascii(substr(sha256('42:' || x), 1, 1)) < 100)"


def _predicted(spans: Column) -> Column:
    """A stand-in for predicted spans: those whose digest starts below d."""
    return F.filter(spans, lambda x: F.substring(H.order_key(x), 1, 1) < "d")


@query(_EV + f""", y AS (SELECT source_id, list_transform(list_filter(ev, lambda e: e.span IS NOT NULL), lambda e: e.span) AS spans FROM x), h AS (SELECT spans, list_transform({_PRED}, lambda x: CASE WHEN ascii(substr(sha256('42:' || x), 2, 1)) < 52 THEN x || '。' ELSE x END) AS pred FROM y),
z AS (SELECT len(spans) AS g, len(pred) AS p, coalesce(list_sum(list_transform(list_distinct(pred), lambda x: least(len(list_filter(pred, lambda y: y = x)), len(list_filter(spans, lambda y: y = x))))), 0) AS o FROM h)
SELECT CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(o) AS BIGINT) AS overlap, round_even(sum(o) / sum(p), 6) AS precision_micro, round_even(sum(o) / sum(g), 6) AS recall_micro, round_even(2 * sum(o) / (sum(p) + sum(g)), 6) AS f1_micro FROM z""")
def micro_spans(s: SparkSession, d: str) -> DataFrame:
    x = evidence(s, d).select(A.spans_of(F.col("ev")).alias("g")).withColumn("p", F.transform(_predicted(F.col("g")), lambda x: F.when(F.substring(H.order_key(x), 2, 1) < "4", F.concat(x, F.lit("。"))).otherwise(x)))
    x = x.agg(F.sum(F.size("g")).alias("gold"), F.sum(F.size("p")).alias("predicted"), F.sum(A.multiset_overlap(F.col("g"), F.col("p"))).alias("overlap"))
    o, p, g = F.col("overlap"), F.col("predicted"), F.col("gold")
    return x.select(big(g).alias("gold"), big(p).alias("predicted"), big(o).alias("overlap"), stats.rate(o, p).alias("precision_micro"), stats.rate(o, g).alias("recall_micro"), stats.rate(2 * o, p + g).alias("f1_micro"))


@query(_EV + f""", y AS (SELECT source_id, list_distinct(list_transform(list_filter(ev, lambda e: e.span IS NOT NULL), lambda e: e.span)) AS spans FROM x), z AS (SELECT source_id, len(spans) AS g, len({_PRED}) AS p FROM y),
r AS (SELECT source_id, CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN g > 0 THEN p / g ELSE 1.0 END AS rc FROM z) SELECT source_id, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM r""")
def set_f1(s: SparkSession, d: str) -> DataFrame:
    g = A.spans_of(F.col("ev"))
    return evidence(s, d).select("source_id", F.round(A.overlap_f1(_predicted(g), g), 6).alias("f1"))



def _valid(f: str) -> str:
    return f"(target.{f} IS NOT NULL AND len(list_filter(target.{f}, lambda i: i IS NULL OR trim(i) = '')) = 0)"


def _list(f: str) -> str:
    return f"CASE WHEN {_valid(f)} THEN list_transform(target.{f}, lambda i: {_STRIP.format('i')}) ELSE [] END"


def _dup(c: str) -> str:
    return f"len(list_distinct({c})) < len({c})"


def _some(c: str, cond: str) -> str:
    return f"len(list_filter({c}, lambda e: coalesce({cond}, false))) > 0"


def _len(c: str) -> str:
    return f"coalesce(length({_STRIP.format(c)}), 0)"


def _coded(rules: dict[str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + "], lambda x: x IS NOT NULL))"


def _codepoints(pattern: str) -> str:
    """A pattern in the dialect of the SQL engine: any decimal digit, wide white space."""
    wide = r"\s\x{3000}\x{a0}"
    return pattern.replace(r"\d", r"\p{Nd}").replace(r"[\s", "[\0").replace(r"\s", f"[{wide}]").replace("\0", wide)


_NUMBER_SQL = "'(?i)" + _codepoints(T.NUMBER.removeprefix("(?<![A-Za-z])")) + "'"
_NUMBERS = "regexp_extract_all(regexp_replace({0}, '([A-Za-z])\\p{{Nd}}', '\\1#', 'g'), " + _NUMBER_SQL.replace("{", "{{").replace("}", "}}") + ")"
_ITEM_OK = f"{_len('e.id')} > 0 AND coalesce(e.span, '') <> '' AND contains(body, e.span) AND coalesce(e.importance IN ('critical', 'supporting'), false) AND {_len('e.role')} >= {AU.SHORT_ROLE}"
_AUDIT_ERRORS = _coded(
    {
        "source_id_missing": "coalesce(source_id, '') = ''", "duplicate_source_id": "times > 1 AND source_id IS NOT NULL", "source_id_not_in_candidates": "NOT known", "case_text_missing": "known AND case_text IS NULL",
        "invalid_split": "coalesce(split, '') NOT IN ('train', 'validation', 'test')", "teacher_model_missing": "coalesce(teacher_model, '') = ''", "candidate_split_mismatch": "known AND split IS DISTINCT FROM csplit",
        "target_missing": "target IS NULL",
    }
    | {
        k: f"target IS NOT NULL AND ({c})"
        for k, c in (
            {
                "invalid_task_type": "coalesce(target.task_type, '') NOT IN ('diagnostic_reasoning', 'confirmed_management')", "invalid_evidence_sufficiency": "level NOT IN ('sufficient', 'partial', 'insufficient', 'conflicting')",
                "query_intent_empty": "coalesce(len(target.query_intent) = 0, false)",
            }
            | {f"{f}_not_list": f"target.{f} IS NULL" for f in ("query_intent", "missing_information", "critical_evidence_ids", "evidence")}
            | {f"{f}_contains_invalid_item": f"target.{f} IS NOT NULL AND NOT {_valid(f)}" for f in ("query_intent", "missing_information", "critical_evidence_ids")}
            | {
                "duplicate_critical_evidence_id": _dup("critical"), "clinical_reasoning_too_short": f"{_len('target.clinical_reasoning')} < {AU.SHORT_REASONING}", "final_answer_too_short": f"{_len('target.final_answer')} < {AU.SHORT_ANSWER}",
                "evidence_item_not_object": "len(ev) < n_items", "evidence_id_missing": _some("ev", f"{_len('e.id')} = 0"), "evidence_span_missing": _some("ev", "coalesce(e.span, '') = ''"),
                "evidence_span_not_in_case": _some("ev", "e.span <> '' AND NOT contains(body, e.span)"), "invalid_evidence_importance": _some("ev", "coalesce(e.importance, '') NOT IN ('critical', 'supporting')"),
                "evidence_role_too_short": _some("ev", f"{_len('e.role')} < {AU.SHORT_ROLE}"), "duplicate_evidence_id": _dup("ids"), "duplicate_evidence_span": _dup("spans"),
                "sufficient_without_evidence": "level = 'sufficient' AND n_items = 0", "partial_without_evidence": "level = 'partial' AND n_items = 0", "conflicting_without_multiple_evidence": "level = 'conflicting' AND n_items < 2",
                "critical_evidence_id_not_found": "len(list_filter(critical, lambda i: NOT list_contains(ids, i))) > 0", "critical_importance_mismatch": "list_sort(list_distinct(critical)) <> list_sort(list_distinct(marked))",
            }
        ).items()
    }
)
_AUDIT_REVIEW = _coded(
    {
        k: f"target IS NOT NULL AND ({c})"
        for k, c in {
            "duplicate_query_intent": _dup("intent"), "duplicate_missing_information": _dup("missing"), "noncanonical_evidence_id": "len(list_filter(ids, lambda i: NOT regexp_full_match(i, 'E[1-9][0-9]*'))) > 0",
            "ambiguous_repeated_evidence_span": "len(list_filter(spans, lambda x: (length(body) - length(replace(body, x, ''))) / length(x) > 1)) > 0", "evidence_span_too_short": "len(list_filter(spans, lambda x: length(x) = 1)) > 0",
            "long_evidence_span_requires_atomicity_review": f"len(list_filter(spans, lambda x: length(x) > {AU.LONG_SPAN})) > 0", "query_like_evidence_span": f"len(list_filter(spans, lambda x: regexp_matches(x, '{T.QUERY_LIKE}'))) > 0",
            "nonsequential_evidence_ids": "ids <> list_transform(range(1, len(ids) + 1), lambda n: 'E' || n)", "overlapping_evidence_spans": "len(list_filter(range(1, len(places)), lambda n: places[n + 1].a < places[n].b)) > 0",
            "partial_without_missing_information": "level = 'partial' AND len(missing) = 0", "insufficient_without_missing_information": "level = 'insufficient' AND len(missing) = 0",
        }.items()
    }
)
_AUDIT_WARNINGS = _coded(
    {
        "candidate_category_mismatch": "known AND category IS DISTINCT FROM ccategory", "task_type_changed_by_teacher": "target IS NOT NULL AND coalesce(hint, '') <> '' AND target.task_type IS DISTINCT FROM hint",
        "too_many_missing_information_items": f"target IS NOT NULL AND len(missing) > {AU.MAX_MISSING}", "too_many_evidence_items": f"target IS NOT NULL AND n_items > {AU.MAX_EVIDENCE}",
        "strong_role_claim_requires_review": "target IS NOT NULL AND " + _some("ev", f"{_len('e.role')} >= {AU.SHORT_ROLE} AND regexp_matches(e.role, '{risk.STRONG_ROLE}')"),
    }
)
#: Rules over a table t of targets with their case; the result is the table i.
_ISSUES = f"""b AS (SELECT *, coalesce(case_text, '') AS body, coalesce(target.evidence_sufficiency, '') AS level, coalesce(len(target.evidence), 0) AS n_items, list_filter(coalesce(target.evidence, []), lambda e: e IS NOT NULL) AS ev,
  {_list('query_intent')} AS intent, {_list('missing_information')} AS missing, {_list('critical_evidence_ids')} AS critical, target.clinical_reasoning || chr(10) || target.final_answer AS written FROM t),
x AS (SELECT *, list_transform(list_filter(ev, lambda e: {_len('e.id')} > 0), lambda e: e.id) AS ids, list_transform(list_filter(ev, lambda e: coalesce(e.span <> '' AND contains(body, e.span), false)), lambda e: e.span) AS spans,
  list_transform(list_filter(ev, lambda e: coalesce(e.importance = 'critical' AND e.id IS NOT NULL, false)), lambda e: e.id) AS marked,
  list_sort(list_transform(list_filter(ev, lambda e: {_ITEM_OK}), lambda e: {{'a': instr(body, e.span), 'b': instr(body, e.span) + length(e.span)}})) AS places,
  list_sort(list_distinct(list_filter({_NUMBERS.format('written')}, lambda n: NOT list_contains({_NUMBERS.format('body')}, n)))) AS new FROM b),
i AS (SELECT *, {_AUDIT_ERRORS} AS errors, {_AUDIT_REVIEW} AS review, list_sort(list_concat({_AUDIT_WARNINGS}, CASE WHEN len(new) > 0 THEN ['generated_numbers_require_review:' || array_to_string(new[1:8], ',')] ELSE [] END)) AS warnings FROM x),"""
_AUDIT = f"""WITH c AS (SELECT * FROM candidate WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY loaded_at NULLS FIRST, source_file NULLS FIRST, source_line NULLS FIRST, case_text NULLS FIRST, original_answer NULLS FIRST, split NULLS FIRST) = 1),
r AS (SELECT DISTINCT source_id, split, category, teacher_model, prompt_version, target FROM audited), t AS (SELECT r.*, count(*) OVER (PARTITION BY r.source_id) AS times, c.source_id IS NOT NULL AS known,
  CASE WHEN {_len('c.case_text')} > 0 THEN c.case_text END AS case_text, c.split AS csplit, c.category AS ccategory, c.task_type_hint AS hint FROM r LEFT JOIN c ON r.source_id = c.source_id),
{_ISSUES}
audit AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN len(review) > 0 THEN 'review' ELSE 'accepted' END AS status FROM i)"""


def _audit(s: SparkSession, d: str) -> DataFrame:
    """The audit without the rule on copied original answers, which needs NFKC (``copied_answers`` has it)."""
    return AU.audit(table(s, d, "audited"), table(s, d, "candidate"), copies=False)


@query(_AUDIT + " SELECT source_id, split, status, array_to_string(errors, '|') AS errors, array_to_string(review, '|') AS review, array_to_string(warnings, '|') AS warnings FROM audit")
def audit_rows(s: SparkSession, d: str) -> DataFrame:
    return _audit(s, d).select("source_id", "split", "status", *[F.array_join(c, "|").alias(c) for c in ("errors", "review", "warnings")])


_CODES = "list_distinct(list_transform({0}, lambda w: split_part(w, ':', 1)))"


@query(_AUDIT + ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS severity, unnest({_CODES.format(c)}) AS code FROM audit" for c in ("errors", "review", "warnings")) + ') SELECT severity, code, count(*) AS "rows" FROM u GROUP BY ALL')
def audit_report(s: SparkSession, d: str) -> DataFrame:
    return AU.issue_report(_audit(s, d))


@query(_AUDIT + f""", u AS (SELECT 'all' AS section, 'total' AS name FROM audit UNION ALL SELECT 'status', status FROM audit UNION ALL SELECT 'split_status', split || ':' || status FROM audit WHERE split IN ('train', 'validation', 'test')
UNION ALL SELECT 'reject_reason', unnest({_CODES.format('errors')}) FROM audit WHERE status = 'rejected' UNION ALL SELECT 'review_reason', unnest({_CODES.format('review')}) FROM audit WHERE status = 'review' UNION ALL SELECT 'warning', unnest({_CODES.format('warnings')}) FROM audit
UNION ALL SELECT 'teacher_model', coalesce(teacher_model, 'None') FROM audit UNION ALL SELECT 'prompt_version', coalesce(prompt_version, 'None') FROM audit UNION ALL SELECT 'task_type', coalesce(target.task_type, 'None') FROM audit WHERE target IS NOT NULL
UNION ALL SELECT 'evidence_sufficiency', coalesce(target.evidence_sufficiency, 'None') FROM audit WHERE target IS NOT NULL UNION ALL SELECT 'evidence_importance', coalesce(e.importance, 'None') FROM (SELECT unnest(target.evidence) AS e FROM audit))
SELECT section, name, count(*) AS "rows", CASE WHEN section = 'status' THEN round(count(*) / (SELECT count(*) FROM audit), 6) END AS rate FROM u GROUP BY section, name""")
def validation_report(s: SparkSession, d: str) -> DataFrame:
    return AU.validation_report(_audit(s, d))


@query()
def copied_answers(s: SparkSession, d: str) -> DataFrame:
    """By status: targets, and those whose final answer is the original answer of their candidate in canonical form (NFKC, which SQL lacks)."""
    x = AU.audit(table(s, d, "audited"), table(s, d, "candidate"))
    return x.groupBy("status").agg(rows_as("n"), F.count_if(F.array_contains("errors", "final_answer_copies_original")).alias("copied"))



def _mended(text: str) -> str:
    """The clean-up of ``delete_spans``; a repeated mark is named once for each mark, as the engine has no back-references in patterns."""
    for pattern, put in T.MENDED:
        if r"\1" in pattern:
            for mark in "，,。；;！？!?：:":
                text = f"regexp_replace({text}, '[{mark}]{{2,}}', '{mark}', 'g')"
        else:
            text = f"regexp_replace({text}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return _STRIP.format(text)


_ONCE = "length({0}) > 0 AND length(case_text) - length(replace(case_text, {0}, '')) = length({0})"
_ASKS = "|".join(m.replace("?", r"\?") for m in masking.QUERY_MARKS)
_VARIANTS = f"""WITH c AS (SELECT source_id, case_text FROM candidate WHERE case_text IS NOT NULL AND source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY loaded_at NULLS FIRST, case_text) = 1),
a AS (SELECT source_id, split, target.evidence AS ev FROM audited WHERE source_id IS NOT NULL AND target.evidence IS NOT NULL AND validation_status = 'accepted' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at NULLS FIRST, split NULLS FIRST) = 1),
l AS (SELECT a.source_id, split, case_text, list_transform(list_filter(ev, lambda e: e.id IS NOT NULL AND coalesce({_ONCE.format('e.span')}, false)), lambda e: {{'id': e.id, 'span': e.span, 'importance': e.importance, 'a': instr(case_text, e.span) - 1, 'b': instr(case_text, e.span) - 1 + length(e.span)}}) AS ev FROM a JOIN c ON a.source_id = c.source_id),
k AS (SELECT *, list_filter(ev, lambda e: coalesce(e.importance = 'critical', false)) AS crit, list_filter(ev, lambda e: coalesce(e.importance = 'supporting', false)) AS sup, list_sort(list_transform(ev, lambda e: {{'a': e.a, 'b': e.b}})) AS places FROM l),
e AS (SELECT *, length(crit[1].span) AS aim FROM k WHERE len(crit) = 1 AND len(sup) > 0 AND len(list_filter(range(1, len(places)), lambda n: places[n + 1].a < places[n].b)) = 0),
r AS (SELECT *, list_sort(list_transform(sup, lambda e: {{'far': abs(length(e.span) - aim), 'tie': sha256('42:' || source_id || ':' || e.id), 'id': e.id, 'span': e.span, 'a': e.a, 'b': e.b}}))[1] AS s1,
 list_sort(list_transform(list_filter(list_transform(list_distinct(list_filter(list_transform(regexp_extract_all(case_text, '{masking.CLAUSE}'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')), lambda x: {{'span': x, 'a': instr(case_text, x) - 1, 'b': instr(case_text, x) - 1 + length(x)}}),
  lambda x: length(x.span) BETWEEN greatest(2, floor(aim * 0.5)) AND greatest(aim * 2, aim + 8) AND {_ONCE.format('x.span')} AND NOT regexp_matches(x.span, '{_ASKS}') AND len(list_filter(ev, lambda e: x.a < e.b AND e.a < x.b)) = 0),
  lambda x: {{'far': abs(length(x.span) - aim), 'tie': sha256('42:' || source_id || ':' || x.a || ':' || x.span), 'span': x.span, 'a': x.a, 'b': x.b}}))[1] AS r1 FROM e),
v AS (SELECT source_id, split, case_text, 'critical' AS mask_type, source_id || '::C:' || crit[1].id AS variant_id, crit[1].span AS removed, crit[1].a AS a, crit[1].b AS b FROM r UNION ALL SELECT source_id, split, case_text, 'supporting', source_id || '::S:' || s1.id, s1.span, s1.a, s1.b FROM r
 UNION ALL SELECT source_id, split, case_text, 'random', source_id || '::R:R1', r1.span, r1.a, r1.b FROM r WHERE r1 IS NOT NULL),
m AS (SELECT source_id, split, variant_id, mask_type, removed, {_mended("left(case_text, a) || substr(case_text, b + 1)")} AS case_text FROM v), variants AS (SELECT * FROM m WHERE case_text <> '' AND NOT contains(case_text, removed))"""  # fmt: skip


@query(_VARIANTS + " SELECT * FROM variants")
def masked_variants(s: SparkSession, d: str) -> DataFrame:
    return masking.mask_variants(table(s, d, "audited"), table(s, d, "candidate"))


@query(_VARIANTS + " SELECT split, mask_type, count(*) AS n FROM variants GROUP BY ALL")
def variant_counts(s: SparkSession, d: str) -> DataFrame:
    return masked_variants(s, d).groupBy("split", "mask_type").agg(rows_as("n"))


# Preference ----------------------------------------------------------------------------------------------------------


def _last_judgments(s: SparkSession, d: str) -> DataFrame:
    """The last row of each pair; of equal rows one."""
    j = table(s, d, "judgment").where("pair_id is not null")
    keys = ["created_at", "loaded_at", "attempt", "status"]
    x = j.select("pair_id", "source_id", "split", "judge_model", *keys, F.col("parsed_judgment").alias("j"))
    top = F.max(F.struct(*keys)).over(_by_pair())
    same = [F.col(k).eqNullSafe(F.col(f"_t.{k}")) for k in keys]
    x = x.withColumn("_t", top).where(same[0] & same[1] & same[2] & same[3]).drop("_t")
    return x.dropDuplicates(["pair_id"])


def _by_pair():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("pair_id")


_LIMITS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in P.SCORES.items()) + "}"
_NAMES = "[" + ", ".join(f"'{k}'" for k in sorted(P.SCORES)) + "]"
_TOTAL = "list_sum(map_values(j.scores.{0}))"
_BADSIDE = f"(j.scores.{{0}} IS NULL OR list_sort(map_keys(j.scores.{{0}})) <> {_NAMES} OR len(list_filter(map_entries(j.scores.{{0}}), lambda e: NOT coalesce(e.value BETWEEN 0 AND {_LIMITS}[e.key], false))) > 0 OR j.hard_failures.{{0}} IS NULL OR len(list_filter(j.hard_failures.{{0}}, lambda h: NOT list_contains(['H1','H2','H3','H4','H5','H6'], h))) > 0)"
_INVALID = f"""(j IS NULL OR j.decision IS NULL OR j.decision NOT IN ('A_better','B_better','tie','both_bad','unjudgeable') OR NOT coalesce(j.confidence BETWEEN 0 AND 1 AND NOT isnan(j.confidence), false) OR trim(coalesce(j.reason, '')) = ''
  OR j.decisive_dimensions IS NULL OR (len(j.decisive_dimensions) = 0 AND j.decision NOT IN ('tie','unjudgeable')) OR len(list_filter(j.decisive_dimensions, lambda x: NOT list_contains({_NAMES}, x))) > 0
  OR {_BADSIDE.replace('{0}', 'a')} OR {_BADSIDE.replace('{0}', 'b')})"""  # fmt: skip
_GATE = f"""CASE WHEN status IS DISTINCT FROM 'ok' THEN 'judgment_not_ok' WHEN {_INVALID} THEN 'invalid_judgment'
 WHEN j.decision NOT IN ('A_better','B_better') THEN 'decision:' || j.decision WHEN j.confidence < 0.85 THEN 'low_confidence'
 WHEN len(CASE WHEN j.decision = 'A_better' THEN j.hard_failures.a ELSE j.hard_failures.b END) > 0 THEN 'chosen_judge_hard_failure'
 WHEN (CASE WHEN j.decision = 'A_better' THEN 1 ELSE -1 END) * ({_TOTAL.format('a')} - {_TOTAL.format('b')}) < 2 THEN 'low_score_margin' ELSE 'qualified' END"""  # fmt: skip


@query(f"SELECT split, {_GATE} AS gate, count(*) AS n FROM (SELECT split, status, parsed_judgment AS j FROM judgment) GROUP BY ALL")
def qualification_gates(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "judgment").select("split", "status", F.col("parsed_judgment").alias("j"))
    return x.groupBy("split", P.qualification(F.col("status"), F.col("j")).alias("gate")).agg(rows_as("n"))



def _side_errors(x: str) -> dict[str, str]:
    return {
        f"invalid_hard_failures:{x}": f"j.hard_failures.{x} IS NULL OR len(list_filter(j.hard_failures.{x}, lambda h: NOT coalesce(list_contains(['H1','H2','H3','H4','H5','H6'], h), false))) > 0",
        f"invalid_scores:{x}": f"j.scores.{x} IS NULL OR list_sort(map_keys(j.scores.{x})) <> {_NAMES} OR len(list_filter(map_entries(j.scores.{x}), lambda e: NOT coalesce(e.value BETWEEN 0 AND {_LIMITS}[e.key], false))) > 0",
    }


_JUDGED = _coded(
    {
        "judgment_missing": "j IS NULL", "invalid_decision": "j IS NOT NULL AND coalesce(j.decision NOT IN ('A_better','B_better','tie','both_bad','unjudgeable'), true)",
        "invalid_confidence": "j IS NOT NULL AND NOT coalesce(j.confidence BETWEEN 0 AND 1 AND NOT isnan(j.confidence), false)", "missing_reason": "j IS NOT NULL AND trim(coalesce(j.reason, '')) = ''",
        "invalid_decisive_dimensions": f"j IS NOT NULL AND (j.decisive_dimensions IS NULL OR (len(j.decisive_dimensions) = 0 AND coalesce(j.decision NOT IN ('tie','unjudgeable'), true)) OR len(list_filter(j.decisive_dimensions, lambda x: NOT coalesce(list_contains({_NAMES}, x), false))) > 0)",
    }
    | {k: f"j IS NOT NULL AND ({c})" for x in "ab" for k, c in _side_errors(x).items()}
)


@query(f"SELECT status, code, count(*) AS n FROM (SELECT status, unnest({_JUDGED}) AS code FROM (SELECT status, parsed_judgment AS j FROM judgment)) GROUP BY ALL")
def judgment_errors(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "judgment").select("status", F.explode(P.judgment_errors(F.col("parsed_judgment"))).alias("code"))
    return x.groupBy("status", "code").agg(rows_as("n"))


_LEAN = "(CASE WHEN f.j.decision = 'A_better' THEN 1 ELSE -1 END) * (list_sum(map_values({0}.j.scores.a)) - list_sum(map_values({0}.j.scores.b)))"
_HARD = "len(CASE WHEN f.j.decision = 'A_better' THEN {0}.j.hard_failures.a ELSE {0}.j.hard_failures.b END) > 0"
_ORDERED = "created_at {0}, loaded_at {0}, attempt {0}, status {0}"
_RECONCILED = f"""WITH r AS (SELECT pair_id, source_id, split, judge_model, status, j, created_at, loaded_at, attempt, {_GATE} AS gate, coalesce({_INVALID}, true) AS bad FROM (SELECT *, parsed_judgment AS j FROM judgment WHERE pair_id IS NOT NULL)),
n AS (SELECT pair_id, count(DISTINCT (created_at, loaded_at, attempt, status)) AS n FROM r GROUP BY pair_id),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY {_ORDERED.format('NULLS FIRST')}) = 1), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY {_ORDERED.format('DESC NULLS LAST')}) = 1),
x AS (SELECT f.pair_id, f.split, CASE WHEN f.gate <> 'qualified' THEN 'original:' || f.gate WHEN n <= 1 THEN 'swap:missing' WHEN f.source_id IS DISTINCT FROM l.source_id OR f.split IS DISTINCT FROM l.split THEN 'swap:metadata_mismatch'
  WHEN l.status IS DISTINCT FROM 'ok' THEN 'swap:not_ok' WHEN l.bad THEN 'swap:invalid_judgment' WHEN f.judge_model IS NOT NULL AND f.judge_model IS DISTINCT FROM l.judge_model THEN 'swap:judge_model_mismatch'
  WHEN l.j.decision = f.j.decision AND l.j.confidence >= 0.85 AND {_LEAN.format('l')} >= 2 AND NOT {_HARD.format('l')} THEN 'strict_bidirectional_decision'
  WHEN NOT (f.j.confidence >= 0.9 AND l.j.confidence >= 0.9) THEN 'tier_b:low_confidence' WHEN NOT ({_LEAN.format('f')} >= 1 AND {_LEAN.format('l')} >= 1) THEN 'tier_b:score_direction_inconsistent'
  WHEN ({_LEAN.format('f')} + {_LEAN.format('l')}) / 2.0 < 2 THEN 'tier_b:low_average_margin' WHEN {_HARD.format('f')} OR {_HARD.format('l')} THEN 'tier_b:winner_hard_failure' ELSE 'score_consistent_bidirectional' END AS reason
  FROM f JOIN l ON f.pair_id = l.pair_id JOIN n ON f.pair_id = n.pair_id), reconciled AS (SELECT pair_id, split, CASE reason WHEN 'strict_bidirectional_decision' THEN 'A' WHEN 'score_consistent_bidirectional' THEN 'B' END AS tier, reason FROM x)"""  # fmt: skip


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    """First against last judged row of a pair, the last taken as the swapped presentation."""
    o = F.struct("created_at", "loaded_at", "attempt", "status")
    row = F.struct("status", "source_id", "split", "judge_model", F.col("parsed_judgment").alias("j"))
    x = table(s, d, "judgment").where("pair_id is not null").groupBy("pair_id").agg(F.min_by(row, o).alias("f"), F.max_by(row, o).alias("l"), F.min(o).alias("o1"), F.max(o).alias("o2"))
    second = F.when(~F.col("o1").eqNullSafe(F.col("o2")), F.struct("l.status", "l.source_id", "l.split", "l.judge_model", P.swapped(F.col("l.j")).alias("j")))
    tier, reason = P.reconcile(F.col("f"), second)
    return x.select("pair_id", "f.split", tier.alias("tier"), reason.alias("reason"))


@query(_RECONCILED + " SELECT pair_id, tier, reason FROM reconciled")
def reconciled_pairs(s: SparkSession, d: str) -> DataFrame:
    return _reconciled(s, d).select("pair_id", "tier", "reason")


@query(_RECONCILED + " SELECT split, tier, reason, count(*) AS n FROM reconciled GROUP BY ALL")
def reconciliation_report(s: SparkSession, d: str) -> DataFrame:
    return _reconciled(s, d).groupBy("split", "tier", "reason").agg(rows_as("n"))


@query()
def exported_pairs(s: SparkSession, d: str) -> DataFrame:
    """Largest feasible quota-bound selection of qualified pairs by split."""
    x = _last_judgments(s, d).where(P.qualification(F.col("status"), F.col("j")) == "qualified")
    kind = H.stable_number(F.col("pair_id"), "type") % 10
    x = x.select(
        "split", "pair_id", F.when(kind < 5, "target_vs_model").when(kind < 9, "model_vs_model").otherwise("controlled_negative").alias("pair_type"), "source_id", P.winner(F.col("j.decision")).alias("position"),
        F.when(H.stable_number(F.col("pair_id"), "tier") % 4 == 0, "B").otherwise("A").alias("tier"), F.col("j.confidence").alias("confidence"), P.margin(F.col("j")).alias("margin"),
    )
    return P.select_pairs(x.where("split is not null"), 400, {"target_vs_model": 0.55, "model_vs_model": 0.35, "controlled_negative": 0.1})


@query(f"""SELECT source_id, 'pair_' || substr(sha256('42:' || source_id || ':target_vs_model:x:y'), 1, 16) AS pair_id, CASE WHEN {_HEAD.format("'42:pair_' || substr(sha256('42:' || source_id || ':target_vs_model:x:y'), 1, 16) || ':blind_position'")} % 2 = 0 THEN 'x' ELSE 'y' END AS a,
CASE WHEN {_HEAD.format("'42:' || source_id || ':controlled'")} % 2 = 0 THEN CASE WHEN level = 'sufficient' THEN 'unnecessary_uncertainty' ELSE 'overconfident_answer' END ELSE 'generic_non_answer' END AS defect
FROM (SELECT source_id, max(target.evidence_sufficiency) AS level FROM audited WHERE source_id IS NOT NULL GROUP BY source_id)""")
def blind_pairs(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "audited").where("source_id is not null").groupBy("source_id").agg(F.max("target.evidence_sufficiency").alias("level"))
    p = P.make_pair(F.col("source_id"), F.lit("target_vs_model"), F.lit("x"), F.lit("y"))
    return x.select("source_id", p["pair_id"].alias("pair_id"), p["a"].alias("a"), P.controlled_negative(F.col("source_id"), F.col("level")).alias("defect"))


# Exam and statistics -------------------------------------------------------------------------------------------------


_EXAM = "SELECT id, exam_type, exam_class, exam_subject, question_type, question, choices, answer FROM exam_question WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY answer NULLS LAST, question, question_type) = 1"
_LETTERS = "array_to_string(list_sort(list_distinct(regexp_extract_all({0}, '[A-F]'))), '')"
_NORM = f"CASE WHEN regexp_matches({{0}}, '[A-F]') AND len(list_filter(regexp_extract_all({{0}}, '[A-F]'), lambda l: NOT contains(keys, l))) = 0 THEN {_LETTERS} END"


def _answers(q: DataFrame, salt: str) -> DataFrame:
    """Stand-in model outputs in many styles, half of them with the right letters; some give no answer or one that is none."""
    n = lambda *x: H.stable_number(F.col("id"), salt, *x)
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (k % 5 + 1).cast("int"))
    one = F.when((n("right") % 2 == 0) & F.col("gold").isNotNull(), F.col("gold")).otherwise(pick(n()))
    two = pick(n("other"))
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    styles = [
        one, c(one, ". 如上所述"), c("分析略。最终答案：", one), F.lit("A项似乎合理，但B项也可能。"), c("分析如下\n", one, "\n以上"), c("选", one, "为宜"), c("（", one, "、", two, "）"),
        c("答案是 ", F.lower(one)), c("选项：", one, "和", two), c("逐项排除\n答：", one, "。"), F.lit(" \n"), c("答案：F，", one),
    ]
    return q.select("id", F.element_at(F.array(*styles), (n("style") % len(styles) + 1).cast("int")).alias("output"))


def _scored(s: SparkSession, d: str, salt: str) -> DataFrame:
    q = exam.questions(table(s, d, "exam_question"))
    return exam.score(q, _answers(q, salt))


def _sql_scored(salt: str) -> str:
    n = lambda *x: _HEAD.format("'42:' || id" + "".join(f" || ':{y}'" for y in (salt, *x)))
    pick = lambda *x: f"substr('ABCDE', CAST({n(*x)} % 5 + 1 AS INT), 1)"
    styles = (
        "one", "one || '. 如上所述'", "'分析略。最终答案：' || one", "'A项似乎合理，但B项也可能。'", "'分析如下' || chr(10) || one || chr(10) || '以上'", "'选' || one || '为宜'", "'（' || one || '、' || two || '）'",
        "'答案是 ' || lower(one)", "'选项：' || one || '和' || two", "'逐项排除' || chr(10) || '答：' || one || '。'", "' ' || chr(10)", "'答案：F，' || one",
    )
    styled = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(styles))
    found = "list_concat(" + ", ".join(f"regexp_extract_all(src, '{_codepoints(p)}', 1)" for p in T.ANSWER_PATTERNS) + ")"
    return f"""SELECT id, exam_class, exam_type, exam_subject, question_type, CASE WHEN src <> '' AND NOT (contains(coalesce(question_type, ''), '单项') AND length(got) <> 1) THEN got END AS answer,
CASE WHEN src = '' THEN 'empty' WHEN got IS NULL THEN 'no_answer_pattern' WHEN contains(coalesce(question_type, ''), '单项') AND length(got) <> 1 THEN 'multiple_for_single' WHEN exact IS NOT NULL THEN 'exact' WHEN lead_norm IS NOT NULL THEN 'leading_option' ELSE 'answer_pattern' END AS method,
coalesce(CASE WHEN src <> '' AND NOT (contains(coalesce(question_type, ''), '单项') AND length(got) <> 1) THEN got END = gold, false) AS correct FROM (
SELECT *, coalesce(exact, lead_norm, valid[-1]) AS got FROM (SELECT *, CASE WHEN compact <> '' AND len(list_filter(string_split(compact, ''), lambda x: NOT contains(keys, x))) = 0 THEN array_to_string(list_sort(list_distinct(string_split(compact, ''))), '') END AS exact,
 CASE WHEN lead <> '' THEN {_NORM.format('lead')} END AS lead_norm, list_filter(list_transform({found}, lambda f: {_NORM.format('f')}), lambda f: f IS NOT NULL) AS valid FROM (
SELECT *, rtrim(regexp_replace(src, '{_codepoints(T.JOINERS)}', '', 'g'), '。.') AS compact, regexp_extract(src, '{_codepoints(T.LEADING_OPTION)}', 1) AS lead FROM (
SELECT *, upper({_STRIP.format('output')}) AS src FROM (SELECT *, CASE CAST({n('style')} % {len(styles)} AS INT) {styled} END AS output FROM (
SELECT *, CASE WHEN {n('right')} % 2 = 0 AND gold IS NOT NULL THEN gold ELSE {pick()} END AS one, {pick('other')} AS two FROM (SELECT *, {_NORM.format('upper(answer)')} AS gold FROM (SELECT *, array_to_string(list_sort(map_keys(choices)), '') AS keys FROM ({_EXAM}))))))))) """


@query("SELECT id, answer, method, correct FROM (" + _sql_scored("m1") + ")")
def exam_scores(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d, "m1").select("id", "answer", "method", "correct")


@query(f"""WITH x AS ({_sql_scored("m1")}), g AS (SELECT exam_class, exam_type, count(*) AS total, count(*) FILTER (correct) AS correct, grouping_id(exam_class, exam_type) AS gi FROM x GROUP BY GROUPING SETS ((), (exam_class), (exam_type)))
SELECT CASE gi WHEN 3 THEN 'all' WHEN 1 THEN 'exam_class' ELSE 'exam_type' END AS dimension, CASE gi WHEN 1 THEN exam_class WHEN 2 THEN exam_type END AS value, total, correct, round(correct / total, 6) AS accuracy FROM g""")
def exam_accuracy(s: SparkSession, d: str) -> DataFrame:
    x = exam.accuracies(_scored(s, d, "m1"), ["exam_class", "exam_type"])
    return x.select("dimension", "value", big(F.col("total")).alias("total"), big(F.col("correct")).alias("correct"), "accuracy")


_Z = stats.Z95


@query(f"""WITH g AS (SELECT exam_class, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (correct) AS DOUBLE) AS k FROM ({_sql_scored("m1")}) GROUP BY exam_class)
SELECT exam_class, round(greatest(0, (k / n + {_Z * _Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS low, round(least(1, (k / n + {_Z * _Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS high FROM g""")
def wilson_intervals(s: SparkSession, d: str) -> DataFrame:
    x = exam.accuracies(_scored(s, d, "m1"), ["exam_class"]).where("dimension = 'exam_class'")
    return x.select(F.col("value").alias("exam_class"), "low", "high")


@query(f"""WITH a AS ({_sql_scored("m1")}), b AS ({_sql_scored("m2")}), p AS (SELECT a.correct AS a, b.correct AS b FROM a JOIN b USING (id)), c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (b AND NOT a) AS better, count(*) FILTER (a AND NOT b) AS worse, count(*) FILTER (a AND b) AS "both" FROM p),
e AS (SELECT *, (better - worse) / n AS dl, sqrt((better + worse - n * ((better - worse) / n) ** 2) / (n - 1) / n) AS se FROM c)
SELECT CAST(n AS BIGINT) AS n, better, worse, "both", round(dl, 6) AS delta, round(dl - {_Z} * se, 6) AS low, round(dl + {_Z} * se, 6) AS high, dl - {_Z} * se >= -0.01 AS not_inferior FROM e""")
def paired_systems(s: SparkSession, d: str) -> DataFrame:
    return exam.paired_comparison(_scored(s, d, "m1"), _scored(s, d, "m2")).drop("p")


@query(f"""WITH a AS ({_sql_scored("m1")}), b AS ({_sql_scored("m2")}), c AS (SELECT count(*) FILTER (b.correct AND NOT a.correct) AS better, count(*) FILTER (a.correct AND NOT b.correct) AS worse FROM a JOIN b USING (id)), n AS (SELECT *, better + worse AS n FROM c),
k AS (SELECT better, worse, n, unnest(range(0, least(better, worse) + 1)) AS k FROM n) SELECT better, worse, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))) END, 8) AS p FROM k GROUP BY better, worse, n""")
def mcnemar_test(s: SparkSession, d: str) -> DataFrame:
    return exam.paired_comparison(_scored(s, d, "m1"), _scored(s, d, "m2")).select("better", "worse", "p")


_PAIRS = f"WITH c AS ({_LATEST}), x AS (SELECT coalesce(a.task, 'None') AS gold, {_TASK} AS pred FROM (SELECT source_id, max(target.task_type) AS task FROM audited WHERE source_id IS NOT NULL GROUP BY source_id) a JOIN c USING (source_id) WHERE c.case_text IS NOT NULL)"


@query(_PAIRS + """, s AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (gold = pred) AS hit FROM x GROUP BY gold), g AS (SELECT pred AS label, count(*) AS given FROM x GROUP BY pred)
SELECT label, support, CASE WHEN coalesce(given, 0) = 0 THEN 0.0 ELSE round_even(hit / given, 6) END AS "precision", round_even(hit / support, 6) AS recall, round_even(2 * hit / (coalesce(given, 0) + support), 6) AS f1 FROM s LEFT JOIN g USING (label)""")
def task_report(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audited").where("source_id is not null").groupBy("source_id").agg(F.max("target.task_type").alias("gold"))
    x = a.join(latest(s, d).where("case_text is not null").select("source_id", T.classify_task(F.col("case_text")).alias("pred")), "source_id")
    return stats.classification(x, "gold", "pred").select("label", big(F.col("support")).alias("support"), "precision", "recall", "f1")


@query("""SELECT source, round(quantile_cont(length(text), 0.025), 6) AS low, round(quantile_cont(length(text), 0.5), 6) AS mid, round(quantile_cont(length(text), 0.975), 6) AS high, round(avg(length(text)), 6) AS mean FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source""")
def length_percentiles(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("source is not null and text is not null").select("source", F.length("text").alias("n"))
    p = lambda q: F.round(F.percentile("n", F.lit(q)), 6)
    return x.groupBy("source").agg(p(0.025).alias("low"), p(0.5).alias("mid"), p(0.975).alias("high"), F.round(F.avg("n"), 6).alias("mean"))


@query()
def bootstrap_intervals(s: SparkSession, d: str) -> DataFrame:
    x = _scored(s, d, "m1").withColumn("value", F.col("correct").cast("double"))
    return stats.bootstrap(x, "exam_class", "value", "id", rounds=1000)


_CUM = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


@query(f"""WITH x AS (SELECT source, length(text) AS n, doc_id FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), r AS (SELECT *, unnest(range(1, 21)) AS round FROM x), u AS (SELECT source, n, round, CAST({_HEAD.format("doc_id || ':' || round")} AS DOUBLE) / {float(1 << 64)} AS u FROM r),
w AS (SELECT source, n, round, {" + ".join(f"CAST(u >= {c!r} AS INT)" for c in _CUM)} AS w FROM u), m AS (SELECT source, round, sum(w * n) / nullif(sum(w), 0) AS m FROM w GROUP BY source, round)
SELECT source, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY source""")
def poisson_intervals(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("source is not null and text is not null").select("source", F.length("text").alias("n"), F.col("doc_id").cast("string").alias("k"))
    return stats.poisson_bootstrap(x, "source", "n", "k", rounds=20).select("source", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH u AS (SELECT id, exam_class AS c FROM ({_EXAM})), x AS (SELECT substr(id, 1, 9) AS unit, sys, CASE WHEN {_HEAD.format("'42:' || id || ':arm'")} % 2 = 0 THEN 'x' ELSE 'y' END AS arm, CAST(correct AS INT) AS v FROM (SELECT id, 'old' AS sys, correct FROM ({_sql_scored('m1')}) UNION ALL SELECT id, 'new', correct FROM ({_sql_scored('m2')}))),
p AS (SELECT unit, max(v) FILTER (sys = 'new' AND arm = 'x') AS a, max(v) FILTER (sys = 'new' AND arm = 'y') AS b, max(v) FILTER (sys = 'old' AND arm = 'x') AS c, max(v) FILTER (sys = 'old' AND arm = 'y') AS e FROM x GROUP BY unit), z AS (SELECT (a - c) - (b - e) AS did FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL)
SELECT count(*) AS n, round(avg(did), 6) AS did, count(*) FILTER (did > 0) AS positive, count(*) FILTER (did < 0) AS negative FROM z""")
def difference_in_differences(s: SparkSession, d: str) -> DataFrame:
    arm = F.when(H.stable_number(F.col("id"), "arm") % 2 == 0, "x").otherwise("y")
    both = _scored(s, d, "m1").withColumn("sys", F.lit("old")).unionByName(_scored(s, d, "m2").withColumn("sys", F.lit("new")))
    x = both.select(F.substring("id", 1, 9).alias("unit"), "sys", arm.alias("arm"), F.col("correct").cast("int").alias("v"))
    return masking.difference_in_differences(x, "unit", "sys", "arm", "v", ("new", "old"), ("x", "y"))


@query(f"""WITH x AS (SELECT id, 'a' AS arm, correct AS v FROM ({_sql_scored('m1')}) UNION ALL SELECT id, 'b', correct FROM ({_sql_scored('m2')})), p AS (SELECT id, max(CAST(v AS INT)) FILTER (arm = 'a') AS t, max(CAST(v AS INT)) FILTER (arm = 'b') AS b FROM x GROUP BY id)
SELECT count(*) AS n, round(avg(t), 6) AS treatment, round(avg(b), 6) AS baseline, round(100 * (avg(t) - avg(b)), 4) AS delta_pp, count(*) FILTER (t = 1 AND b = 0) AS treatment_only, count(*) FILTER (t = 0 AND b = 1) AS baseline_only FROM p""")
def paired_effect(s: SparkSession, d: str) -> DataFrame:
    x = _scored(s, d, "m1").select("id", F.lit("a").alias("arm"), "correct").unionByName(_scored(s, d, "m2").select("id", F.lit("b").alias("arm"), "correct"))
    return masking.paired_effect(x, "id", "arm", "correct", "a", "b")


@query(f"""SELECT id, '以下是中国' || coalesce(exam_type, '') || '中' || coalesce(exam_class, '') || '考试的一道' || coalesce(question_type, '选择题') || '。{T.PLAIN_INSTRUCTION}' || chr(10) || chr(10) || coalesce(question, '') || chr(10) ||
array_to_string(list_transform(map_entries(choices), lambda e: e.key || '. ' || coalesce(e.value, '')), chr(10)) || chr(10) || chr(10) || '答案：' AS prompt FROM ({_EXAM}) WHERE choices IS NOT NULL AND cardinality(choices) > 0""")
def exam_prompts(s: SparkSession, d: str) -> DataFrame:
    x = exam.first_rows(table(s, d, "exam_question"))
    return x.select("id", T.exam_prompt(F.col("exam_type"), F.col("exam_class"), F.col("question_type"), F.col("question"), F.col("choices")).alias("prompt")).where("prompt is not null")


# Retrieval, chat, JSON, reports --------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, i.vec_id AS vec_id, list_cosine_similarity(q.e, i.e) AS s FROM v q, v i WHERE q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)
SELECT query_id, vec_id, round(s, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS "rank" FROM p QUALIFY "rank" <= 10""")
def nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    x = retrieval.top_k(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", 10)
    return x.select("query_id", "vec_id", F.round("score", 5).alias("score"), big(F.col("rank")).alias("rank"))


_TURNS = "SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view', 'search') THEN 'human' ELSE 'gpt' END AS role, event_type || ':' || event_id AS text FROM events"


def turns(s: SparkSession, d: str) -> DataFrame:
    """Events as turns of a conversation with each user."""
    role = F.when(F.col("event_type").isin("click", "view", "search"), "human").otherwise("gpt")
    return table(s, d, "events").select("user_id", "ts", "event_id", role.alias("role"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("text"))


@query(f"""WITH t AS ({_TURNS}) SELECT event_id, text, user_text FROM (SELECT event_id, text, role, last_value(CASE WHEN role = 'human' THEN text END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_text FROM t) WHERE role = 'gpt'""")
def last_user_text(s: SparkSession, d: str) -> DataFrame:
    return chat.last_user(turns(s, d), "user_id", "event_id", "role", "text").select("event_id", "text", "user_text")


def conversations(s: SparkSession, d: str) -> DataFrame:
    c = F.array_sort(F.collect_list(F.struct("event_id", F.col("role").alias("from"), F.col("text").alias("value"))))
    return turns(s, d).groupBy("user_id").agg(F.transform(c, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("turns"))


@query(f"""WITH t AS ({_TURNS}), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, role ORDER BY event_id) AS island FROM t),
g AS (SELECT user_id, role, island, min(event_id) AS first_id, string_agg(text, chr(10) ORDER BY event_id) AS all_text, min_by(text, event_id) AS first_text FROM o GROUP BY ALL),
p AS (SELECT user_id, role, lead(role) OVER (PARTITION BY user_id ORDER BY first_id) AS nxt, all_text AS u, lead(first_text) OVER (PARTITION BY user_id ORDER BY first_id) AS a, first_id FROM g)
SELECT user_id, count(*) AS pairs, sha256(string_agg(u || chr(9) || a, chr(10) ORDER BY first_id)) AS digest FROM p WHERE role = 'human' AND nxt = 'gpt' GROUP BY user_id""")
def folded_history(s: SparkSession, d: str) -> DataFrame:
    x = conversations(s, d).select("user_id", chat.folded_history(F.col("turns")).alias("h")).where("size(h) > 0")
    text = F.array_join(F.transform("h", lambda p: F.concat(p["user"], F.lit("\t"), p["assistant"])), "\n")
    return x.select("user_id", big(F.size("h")).alias("pairs"), F.sha2(text, 256).alias("digest"))


@query(f"""WITH t AS ({_TURNS}), q AS (SELECT user_id, min(event_id) AS qi, min_by(text, event_id) AS question FROM t WHERE role = 'human' GROUP BY user_id) SELECT q.user_id, question, (SELECT min_by(text, event_id) FROM t WHERE t.user_id = q.user_id AND role = 'gpt' AND event_id > qi) AS answer FROM q""")
def question_answers(s: SparkSession, d: str) -> DataFrame:
    q, a = chat.question_answer(F.col("turns"))
    return conversations(s, d).select("user_id", q.alias("question"), a.alias("answer")).where("question is not null")


@query("SELECT doc_id, length(text) + coalesce(length(category), 0) BETWEEN 1 AND 400 AS fits FROM documents WHERE text IS NOT NULL")
def length_filter(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("text is not null")
    return x.select("doc_id", chat.length_within(F.col("text"), F.coalesce("category", F.lit("")), 400).alias("fits"))


@query()
def payload_objects(s: SparkSession, d: str) -> DataFrame:
    """Payloads that are one object, and the first object inside those that are not."""
    x = table(s, d, "sft_candidates").where("payload is not null").select("raw_id", jsonx.strict_object("payload").isNotNull().alias("strict"), jsonx.first_object("payload").isNotNull().alias("first"), jsonx.any_object("payload").isNotNull().alias("found"))
    return x.groupBy("strict", "first", "found").agg(rows_as("n"))


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem) SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(net), 4) AS mean_net FROM x GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouped_report(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return x.rollup("l_returnflag", "l_linestatus").agg(rows_as("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("net"), 4).alias("mean_net"))


@query("""WITH d0 AS (SELECT count(*) AS total, count(*) FILTER (validation_status = 'accepted') AS accepted FROM audited), d1 AS (SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS accepted FROM judgment)
SELECT metric, CAST(v0 AS BIGINT) AS audited, CAST(v1 AS BIGINT) AS judged FROM d0, d1, LATERAL (VALUES ('rows', d0.total, d1.total), ('accepted', d0.accepted, d1.accepted)) AS t(metric, v0, v1)""")
def metric_table(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "audited").agg(rows_as("r0"), big(F.count_if(F.col("validation_status") == "accepted")).alias("a0"))
    j = table(s, d, "judgment").agg(rows_as("r1"), big(F.count_if(F.col("status") == "ok")).alias("a1"))
    return a.crossJoin(j).selectExpr("stack(2, 'rows', r0, r1, 'accepted', a0, a1) as (metric, audited, judged)")  # one row each


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(s: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(table(s, d, "events"), "ts", "event_type").withColumn("n", big(F.col("rows"))).drop("rows")


@query("SELECT split, task, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM (SELECT split, target.task_type AS task, count(*) AS n FROM audited WHERE split IS NOT NULL GROUP BY ALL)")
def shares_by_split(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    x = table(s, d, "audited").where("split is not null").groupBy("split", F.col("target.task_type").alias("task")).agg(rows_as("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6))


@query("""SELECT judge_model, attempt, finish_reason, count(*) AS n, round(avg(length(parsed_judgment.reason)), 6) AS mean_reason FROM judgment GROUP BY ALL""")
def judge_calls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "judgment").groupBy("judge_model", "attempt", "finish_reason").agg(rows_as("n"), F.round(F.avg(F.length("parsed_judgment.reason")), 6).alias("mean_reason"))


# Records, clinical comparison, risk ----------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE WHEN trim(coalesce(category, '')) <> '' THEN category || '：' || text ELSE text END AS question, source AS answer FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def labelled_conversations(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("text is not null and source is not null").select("doc_id", F.col("text").alias("question"), F.col("source").alias("answer"), "category")
    t = F.col("conversations")
    return records.to_conversation(x).select("doc_id", t[0]["value"].alias("question"), t[1]["value"].alias("answer"))


@query(f"WITH c AS ({_LATEST}) SELECT case_text AS prompt, original_answer AS chosen, category AS rejected FROM c WHERE case_text IS NOT NULL AND original_answer IS NOT NULL AND category IS NOT NULL")
def preference_records(s: SparkSession, d: str) -> DataFrame:
    return records.preference_record(latest(s, d), "case_text", "original_answer", "category")


_CASES = "SELECT source_id, max(case_text) AS case_text FROM candidate WHERE case_text IS NOT NULL AND source_id IS NOT NULL GROUP BY source_id"


@query(f"""WITH c AS ({_CASES}), a AS (SELECT source_id, split, target, CAST(to_json({{'task_type': target.task_type, 'query_intent': target.query_intent, 'evidence_sufficiency': target.evidence_sufficiency,
'evidence': list_transform(target.evidence, lambda e: {{'id': e.id, 'span': e.span, 'importance': e.importance, 'role': e.role}}), 'critical_evidence_ids': target.critical_evidence_ids, 'missing_information': target.missing_information, 'clinical_reasoning': target.clinical_reasoning, 'final_answer': target.final_answer}}) AS VARCHAR) AS answer, created_at
FROM audited WHERE target IS NOT NULL AND source_id IS NOT NULL), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at NULLS FIRST, answer) = 1)
SELECT o.source_id, split, target.task_type AS task_type, '请根据病例回答：' || case_text AS prompt, answer FROM o JOIN c ON o.source_id = c.source_id""")
def training_rows(s: SparkSession, d: str) -> DataFrame:
    x = records.training_rows(table(s, d, "audited"), table(s, d, "candidate"), "请根据病例回答：")
    return x.select("source_id", "split", "task_type", F.col("conversations")[0]["value"].alias("prompt"), F.col("conversations")[1]["value"].alias("answer"))


@query("""WITH j AS (SELECT pair_id, parsed_judgment AS j FROM judgment WHERE status = 'ok' AND parsed_judgment.scores.a IS NOT NULL AND parsed_judgment.scores.b IS NOT NULL), x AS (
SELECT pair_id, 'a' AS label, unnest(map_entries(j.scores.a)) AS e FROM j UNION ALL SELECT pair_id, 'b', unnest(map_entries(j.scores.b)) FROM j), m AS (SELECT pair_id, label, e.key AS dimension, avg(e.value) AS score FROM x GROUP BY ALL),
p AS (SELECT pair_id, dimension, max(score) FILTER (label = 'a') AS b, max(score) FILTER (label = 'b') AS c FROM m GROUP BY ALL) SELECT dimension, count(*) AS items, round(avg(c - b), 6) AS delta FROM p WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY dimension""")
def score_deltas(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "judgment").where("status = 'ok' and parsed_judgment.scores.a is not null and parsed_judgment.scores.b is not null and pair_id is not null")
    j = j.select("pair_id", F.col("parsed_judgment.scores").alias("scores"), F.lit("a").alias("la"), F.lit("b").alias("lb"))
    x = clinical.mean_deltas(clinical.side_scores(j, "pair_id", "scores", "la", "lb"), "pair_id", "a", "b")
    return x.select("dimension", big(F.col("items")).alias("items"), "delta")


@query("""WITH o AS (SELECT CASE parsed_judgment.decision WHEN 'A_better' THEN 'base' WHEN 'B_better' THEN 'cand' ELSE parsed_judgment.decision END AS o FROM judgment WHERE status = 'ok'), c AS (SELECT count(*) AS "rows", count(*) FILTER (o = 'base') AS base_wins, count(*) FILTER (o = 'cand') AS cand_wins, count(*) FILTER (o = 'tie') AS ties FROM o)
SELECT *, round(cand_wins / nullif(base_wins + cand_wins + ties, 0), 6) AS win_rate, round((cand_wins - base_wins) / nullif(base_wins + cand_wins + ties, 0), 6) AS net_win_rate FROM c""")
def win_rates(s: SparkSession, d: str) -> DataFrame:
    o = clinical.mapped_winner(F.col("parsed_judgment.decision"), F.lit("base"), F.lit("cand"))
    return clinical.outcome_rates(table(s, d, "judgment").where("status = 'ok'").select(o.alias("o")), "o", "base", "cand")


@query()
def cluster_interval(s: SparkSession, d: str) -> DataFrame:
    return clinical.cluster_interval(_scored(s, d, "m1").withColumn("v", F.col("correct").cast("int")), "exam_subject", "v")


@query("""WITH t AS (SELECT user_id, event_id, event_type AS q, CAST(value AS VARCHAR) AS a FROM events) SELECT event_id, count(q) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turns_before, first_value(q) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_question FROM t""")
def carried_history(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", F.col("event_type").alias("q"), F.col("value").cast("string").alias("a"))
    x = clinical.carried_history(e, "user_id", "event_id", "q", "a")
    return x.select("event_id", big(F.size("history")).alias("turns_before"), F.try_element_at("history", F.lit(1))["question"].alias("first_question"))


@query()
def export_checks(s: SparkSession, d: str) -> DataFrame:
    """Errors of the exported selection by split; a row says how many there are, none is 0."""
    x = clinical.export_errors(exported_pairs(s, d), {"target_vs_model": 0.55, "model_vs_model": 0.35, "controlled_negative": 0.1})
    return x.agg(rows_as("errors"), F.array_join(F.array_sort(F.collect_set("error")), ",").alias("codes"))



_MARK = "'(?i)(" + _codepoints(T.NUMBER_WITH_UNIT.removeprefix("(?<![A-Za-z0-9])")) + ")'"
_W = r"'[\s\x{3000}\x{a0}]+'"


def _measures(text: str) -> str:
    """SQL list of (key, label, unit, listed) of the numbers in a text."""
    marked = f"regexp_replace(regexp_replace({text}, '([A-Za-z])\\p{{Nd}}+', '\\1#', 'g'), {_MARK}, chr(1) || '\\1' || chr(2), 'g')"
    raw = f"list_transform(string_split({marked}, chr(1))[2:], lambda p: {{'raw': split_part(p, chr(2), 1), 'nxt': left(split_part(p, chr(2), 2), 1)}})"
    unit = f"lower(regexp_replace(regexp_extract(m.raw, '[^\\p{{Nd}}.\\s\\x{{3000}}\\x{{a0}}].*$'), {_W}, '', 'g'))"
    label = f"CASE WHEN {unit} IN ('小时', '分钟', '秒') THEN lower(regexp_replace(m.raw, {_W}, '', 'g')) ELSE lower(regexp_extract(m.raw, {_NUMBER_SQL.replace('(?i)', '(?i)^')})) END"
    return f"list_transform({raw}, lambda m: {{'key': regexp_extract(m.raw, '^\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?'), 'label': {label}, 'unit': {unit}, 'listed': {unit} = '' AND m.nxt IN ('.', '、', ')', '）')}})"


_UNITS = "[" + ", ".join(f"'{u}'" for u in T.MEDICAL_UNITS) + "]"
_RISK = f"""m AS (SELECT *, {_measures("coalesce(case_text, '')")} AS known, {_measures("coalesce(written, '')")} AS said FROM a),
k AS (SELECT *, list_filter(said, lambda x: NOT x.listed AND CASE WHEN x.unit <> '' THEN NOT list_contains(list_transform(known, lambda y: y.key), x.key) ELSE NOT list_contains(list_transform(known, lambda y: y.label), x.label) END) AS new FROM m),
n AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(new, lambda x: list_contains({_UNITS}, x.unit)), lambda x: x.label))) AS high, list_sort(list_distinct(list_transform(list_filter(new, lambda x: NOT list_contains({_UNITS}, x.unit)), lambda x: x.label))) AS medium FROM k)"""


@query(f"WITH c AS ({_CASES}), a AS (SELECT DISTINCT a.source_id, concat_ws(chr(10), target.clinical_reasoning, target.final_answer) AS written, c.case_text FROM audited a JOIN c ON a.source_id = c.source_id WHERE target.final_answer IS NOT NULL), {_RISK} SELECT source_id, array_to_string(high, ',') AS high, array_to_string(medium, ',') AS medium FROM n")
def number_risks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "candidate").where("case_text is not null").groupBy("source_id").agg(F.max("case_text").alias("case_text"))
    a = table(s, d, "audited").where("source_id is not null and target.final_answer is not null").select("source_id", F.concat_ws("\n", "target.clinical_reasoning", "target.final_answer").alias("text")).distinct()
    r = a.join(c, "source_id").select("source_id", risk.number_risk(F.col("case_text"), F.col("text")).alias("r"))
    return r.select("source_id", F.array_join("r.high", ",").alias("high"), F.array_join("r.medium", ",").alias("medium"))


_CLAUSES = f"list_transform(range(1, len(pieces)), lambda i: regexp_split_to_array(array_to_string(pieces[1:i], '#'), '{risk.CLAUSE_END}')[-1])"
_ROLE = f"""CASE WHEN span IS NULL OR role IS NULL THEN 'clean' WHEN len(list_filter({_CLAUSES}, lambda c: NOT regexp_matches(c, '{risk.HEDGED_PREFIX}'))) = 0 OR regexp_matches(role, '{risk.NONCLINICAL}') OR regexp_matches(role, '{risk.RESOLVED}')
 OR (regexp_matches(span, '{risk.DIRECT_DIAGNOSIS}') AND regexp_matches(role, '诊断|确诊')) OR contains(span, '排除') THEN 'clean' WHEN regexp_matches(span, '{risk.NEGATIVE_FINDING}') OR regexp_matches(span, '没|不是') THEN 'medium' ELSE 'high' END"""


# roles of the data make few claims, so each role is also judged with a claim before and after it
_CLAIMS = ("", "可以排除其他疾病，", "不能证实，但确定为该病，")


@query(f"""WITH e AS (SELECT DISTINCT source_id, e.id AS evidence_id, e.span AS span, e.role AS plain FROM (SELECT source_id, unnest(target.evidence) AS e FROM audited)), v AS (SELECT *, unnest({list(_CLAIMS)}) AS claim FROM e),
r AS (SELECT *, claim || plain AS role, regexp_split_to_array(claim || plain, '{risk.STRONG_ROLE}') AS pieces FROM v) SELECT source_id, evidence_id, span, role, {_ROLE} AS risk FROM r""")
def role_risks(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "audited").select("source_id", F.explode("target.evidence").alias("e")).select("source_id", F.col("e.id").alias("evidence_id"), F.col("e.span").alias("span"), F.col("e.role").alias("plain")).distinct()
    x = e.withColumn("claim", F.explode(F.array(*[F.lit(c) for c in _CLAIMS]))).select("source_id", "evidence_id", "span", F.concat("claim", "plain").alias("role"))
    return x.withColumn("risk", risk.role_risk(F.col("span"), F.col("role")))


_RISK_RULES = f"""{_RISK},
e AS (SELECT row_number() OVER () AS rid, * FROM n), i AS (SELECT rid, coalesce(e.id, 'unknown') AS id, e.span AS span, e.role AS role, regexp_split_to_array(e.role, '{risk.STRONG_ROLE}') AS pieces, place FROM (SELECT rid, unnest(target.evidence) AS e, generate_subscripts(target.evidence, 1) AS place FROM e)),
g AS (SELECT rid, coalesce(list(id ORDER BY place) FILTER (risk = 'high'), []) AS high_ids, coalesce(list(id ORDER BY place) FILTER (risk = 'medium'), []) AS medium_ids FROM (SELECT rid, id, place, {_ROLE} AS risk FROM i) GROUP BY rid),
w AS (SELECT e.*, coalesce(high_ids, []) AS high_ids, coalesce(medium_ids, []) AS medium_ids, list_transform(coalesce(warnings, []), lambda w: split_part(w, ':', 1)) AS codes FROM e LEFT JOIN g USING (rid)),
z AS (SELECT *, list_filter([CASE WHEN list_contains(codes, 'task_type_changed_by_teacher') THEN {{'r': 1, 'why': 'teacher_task_type_correction_audit_only'}} END, CASE WHEN len(high_ids) > 0 THEN {{'r': 3, 'why': 'unsupported_unhedged_strong_role:' || array_to_string(high_ids, ',')}} END,
 CASE WHEN len(medium_ids) > 0 THEN {{'r': 2, 'why': 'context_supported_strong_role_requires_review:' || array_to_string(medium_ids, ',')}} END, CASE WHEN len(high_ids) + len(medium_ids) = 0 AND list_contains(codes, 'strong_role_claim_requires_review') THEN {{'r': 1, 'why': 'strong_role_warning_resolved_by_context'}} END,
 CASE WHEN written IS NOT NULL AND len(high) > 0 THEN {{'r': 3, 'why': 'unsupported_medical_parameter:' || array_to_string(high[1:8], ',')}} END, CASE WHEN written IS NOT NULL AND len(medium) > 0 THEN {{'r': 2, 'why': 'unsupported_time_or_unitless_number:' || array_to_string(medium[1:8], ',')}} END,
 CASE WHEN list_contains(codes, 'generated_numbers_require_review') AND (written IS NULL OR len(high) + len(medium) = 0) THEN {{'r': 1, 'why': 'generated_number_warning_resolved_as_enumeration'}} END], lambda x: x IS NOT NULL) AS rules FROM w),
target_risk AS (SELECT *, ['clean', 'low', 'medium', 'high'][coalesce(list_max(list_transform(rules, lambda x: x.r)), 0) + 1] AS level, array_to_string(list_transform(rules, lambda x: x.why), '|') AS reasons FROM z)"""
_TARGET_RISK = f"""WITH c AS ({_CASES}), a AS (SELECT DISTINCT a.source_id, a.split, a.target, a.validation_warnings AS warnings, c.case_text, target.clinical_reasoning || chr(10) || target.final_answer AS written FROM audited a JOIN c ON a.source_id = c.source_id WHERE target IS NOT NULL), {_RISK_RULES}"""


def _risks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "candidate").where("case_text is not null and source_id is not null").groupBy("source_id").agg(F.max("case_text").alias("case_text"))
    a = table(s, d, "audited").where("target is not null").select("source_id", "split", "target", "validation_warnings").distinct().join(c, "source_id")
    return a.withColumn("risk", risk.target_risk(F.col("case_text"), F.col("target"), F.col("validation_warnings")))


@query(_TARGET_RISK + " SELECT source_id, level, reasons FROM target_risk")
def target_risks(s: SparkSession, d: str) -> DataFrame:
    return _risks(s, d).select("source_id", "risk.level", F.array_join("risk.reasons", "|").alias("reasons"))


@query(_TARGET_RISK + f""" SELECT source_id, split, level, CASE WHEN split IS NULL OR split NOT IN ('train', 'validation') THEN 'locked_split' WHEN len(list_filter(coalesce(warnings, []), lambda w: regexp_matches(w, '^(?:{"|".join(risk.HIGH_RISK_WARNINGS)})'))) > 0 THEN 'warning_policy' ELSE 'kept' END AS strict,
CASE WHEN split IS NULL OR split NOT IN ('train', 'validation') THEN 'locked_split' WHEN level = 'high' THEN 'warning_risk' ELSE 'kept' END AS tiered, CASE WHEN split IS NULL OR split NOT IN ('train', 'validation') THEN 'locked_split' ELSE 'kept' END AS "all" FROM target_risk""")
def warning_policies(s: SparkSession, d: str) -> DataFrame:
    """What each of the three warning policies makes of a target; test and unknown splits are locked."""
    x = _risks(s, d)
    open_ = F.coalesce(F.col("split").isin("train", "validation"), F.lit(False))
    gate = lambda veto, name: F.when(~open_, "locked_split").when(veto, name).otherwise("kept")
    return x.select("source_id", "split", "risk.level", gate(risk.has_high_risk_warning(F.col("validation_warnings")), "warning_policy").alias("strict"), gate(F.col("risk.level") == "high", "warning_risk").alias("tiered"), gate(F.lit(False), "").alias("all"))
